"""Exact top-k by inner product (operator 8).

Query rows and candidate rows are packed into tiles. Each task multiplies one query tile by one candidate tile, takes
the best few of each query by a partial selection, and lists of neighbouring shards are merged, FAN_IN at a time, up
to one list a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import cut, map_batches, shuffled

#: Rows of a query tile and of a candidate tile; lists merged into one in a step.
QUERY_TILE, SHARD_TILE, FAN_IN = 2048, 4096, 16
#: Products up to this size are exact in a float64 matrix product.
EXACT = 1 << 53

_TILE = pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()),
                   ("matrix", pa.binary())])
_PACKED = "part int, dim int, kind string, ids binary, matrix binary"
_FOUND = pa.schema([("query_id", pa.int64()), ("part", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _vectors(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): components as doubles; rows with null or non-finite parts (once scaled) left out."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.col("embedding").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    return rows.select("vec_id", F.col("x").alias("v"))


def _packed(ids: list[int], vectors: list, scale: int) -> dict:
    """The columns of a tile: components in the smallest kind of number that holds them."""
    v = np.floor(np.array(vectors, dtype="<f8").reshape(len(ids), -1) * scale)
    most = np.abs(v).max(initial=0.0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return {"dim": v.shape[1], "kind": kind, "ids": np.array(ids, "<i8").tobytes(), "matrix": v.astype(kind).tobytes()}


def _pack(tile: int, scale: int):
    """Rows of one dimension, packed ``tile`` at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}

        def close(dim):
            return pa.RecordBatch.from_pylist([{"part": part, **_packed(*held.pop(dim), scale)}], schema=_TILE)

        for batch in batches:
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(vec_id)
                vectors.append(v)
                if len(ids) >= tile:
                    yield close(len(v))
        for dim in list(held):
            yield close(dim)
    return run


#: Scores are kept within 64 bits.
_MOST = (1 << 63) - 1


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: float64 where no sum can leave its exact range, else 64-bit integers; rows whose scores
    may not fit 64 bits are multiplied in unbounded integers."""
    q_most, c_most = np.abs(q).max(axis=1, initial=0.0), np.abs(c).max(axis=1, initial=0.0)
    bound = q_most.max(initial=0.0) * c_most.max(initial=0.0) * max(1, q.shape[1])
    if bound < EXACT:
        return (q @ c.T).astype(np.int64)
    if bound < 2.0 ** 63:
        return q.astype(np.int64) @ c.astype(np.int64).T
    # Few rows are that large: a pair without any of them fits.
    limit = (2.0 ** 62 / max(1, q.shape[1])) ** 0.5
    big_q, big_c = q_most > limit, c_most > limit
    out = np.empty((len(q), len(c)), np.int64)
    out[np.ix_(~big_q, ~big_c)] = _product(q[~big_q], c[~big_c])
    for rows, columns in ((big_q, np.ones(len(c), bool)), (~big_q, big_c)):
        if rows.any() and columns.any():
            whole = _integers(q[rows]) @ _integers(c[columns]).T
            out[np.ix_(rows, columns)] = np.clip(whole, -_MOST, _MOST).astype(np.int64)
    return out


def _integers(v: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in v.tolist()], dtype=object).reshape(v.shape)


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                q_ids, c_ids = np.frombuffer(t["q_ids"], "<i8"), np.frombuffer(t["ids"], "<i8")
                c = np.frombuffer(t["matrix"], t["kind"]).reshape(len(c_ids), t["dim"]).astype(np.float64)
                q = np.frombuffer(t["q_matrix"], t["q_kind"]).reshape(len(q_ids), t["dim"]).astype(np.float64)
                out_q, out_c, out_s = [], [], []
                for at in range(0, len(q_ids), 256):
                    scores = _product(q[at:at + 256], c)
                    for row, query in zip(scores, q_ids[at:at + 256]):
                        other = np.flatnonzero(c_ids != query)
                        s = row[other]
                        if len(s) > k:  # all that reach the k-th best, so that ties are settled by vec_id
                            top = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                            s, other = s[top], other[top]
                        order = np.lexsort((c_ids[other], -s))[:k]
                        out_q.append(np.full(len(order), query, np.int64))
                        out_c.append(c_ids[other[order]].astype(np.int64))
                        out_s.append(s[order].astype(np.int64))
                q_all = np.concatenate(out_q) if out_q else np.zeros(0, np.int64)
                if len(q_all):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(q_all), pa.array(np.full(len(q_all), t["part"], np.int32)),
                        pa.array(np.concatenate(out_c)), pa.array(np.concatenate(out_s))], schema=_FOUND)
    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, query_tile: int = QUERY_TILE,
          shard_tile: int = SHARD_TILE, fan_in: int = FAN_IN) -> DataFrame:
    """The k best-scoring other rows of each query: query_id, rank (from 1), vec_id, score.

    ``rows`` has vec_id and embedding; ``is_query`` tells the queries among them. The score is the inner product of
    floor(scale * x). Ties go to the smaller vec_id. A query's candidates are all rows of another vec_id and the same
    dimension; if they are fewer than k, all of them. Rows with a null vec_id, and vectors that are null or hold null
    or non-finite components (after scaling, too), take no part. A score beyond 64 bits counts as the largest (or
    smallest) number of 64 bits. Repeated candidate rows count as often as they stand in the table;
    repeated query rows count once, and a query id with different vectors has one list, of all its vectors' scores.
    Queries without a candidate, and empty tables, give no rows.
    """
    spark = rows.sparkSession
    shards = cut(map_batches(_vectors(rows, scale), _pack(shard_tile, scale), _PACKED), "topk-shards")
    queries = cut(_vectors(rows.where(is_query), scale).distinct(), "topk-query-rows")
    queries = queries.repartition(max(1, -(-queries.count() // query_tile)))
    queries = cut(map_batches(queries, _pack(query_tile, scale), _PACKED), "topk-queries")

    # Each query tile goes once to each group of shards; a group's task multiplies it by the group's shards in turn.
    # Tiles are blocks of thousands of rows: no pair of rows is ever a row of a join.
    parts, tiles = shards.agg(F.coalesce(F.max("part"), F.lit(0)) + 1, F.count("*")).first()
    groups = max(1, min(tiles, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sent = queries.select("dim", F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"),
                          F.col("matrix").alias("q_matrix"),
                          F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    dealt = shards.withColumn("group", F.pmod(F.xxhash64("part", "ids"), F.lit(groups)).cast("int"))
    met = dealt.join(shuffled(sent), ["group", "dim"])
    lists = map_batches(met.select("part", "dim", "kind", "ids", "matrix", "q_kind", "q_ids", "q_matrix"), _best(k),
                        "query_id long, part int, vec_id long, score long")

    # Merge tree: shards of a part, then FAN_IN neighbouring parts at a time, at most k rows a list.
    lists = cut(lists.select("query_id", F.col("part").alias("node"), F.struct(
        (-F.col("score")).alias("less"), "vec_id").alias("hit")), "topk-lists")
    while True:
        merged = lists.groupBy("query_id", "node").agg(
            F.slice(F.array_sort(F.collect_list("hit")), 1, k).alias("hits"))
        if parts <= 1:
            break
        parts = -(-parts // fan_in)
        lists = cut(merged.select("query_id", F.expr(f"CAST(node DIV {fan_in} AS int)").alias("node"),
                                  F.explode("hits").alias("hit")), "topk-lists")
    return merged.select("query_id", F.posexplode("hits").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.less")).alias("score"))
