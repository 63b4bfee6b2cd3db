"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bound on one Arrow batch sent to a Python worker, so that very long texts do not pile up in its memory.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a missing setting is an
    error, because a machine-local folder would hide one executor's files from the others.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of the table, never a second run of what made it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch for the Python stages that follow."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches. A worker that has done its task gives its free memory back to the system:
    it may stand idle beside stages that need none of it."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        import ctypes
        import gc

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library: it has no such call
            pass
    return df.mapInArrow(run, schema)


def worker_memo(key: str, make: Callable):
    """What ``make()`` gave in this Python worker before, by ``key``; functions are shipped by value, so their module
    globals live for one task only, the worker process for many."""
    memo = sys.__dict__.setdefault("_runscope_worker_memo", {})
    if key not in memo:
        memo[key] = make()
    return memo[key]


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. All-ASCII text (as many characters as bytes) takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the doc_id written as text, modulo ``mod`` (a null doc_id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


#: A frame of up to this many bytes may be broadcast; beyond it, a join shuffles.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, row_bytes: int, items: str | None = None, item_bytes: int = 8) -> DataFrame:
    """Hint a broadcast of a frame if its size, counted now, is within BROADCAST_BYTES; else a join that shuffles.

    ``items`` names an array column, whose elements count ``item_bytes`` each. The frame should be a written table.
    """
    inside = F.sum(F.size(items)) if items else F.lit(0)
    rows, elements = df.agg(F.count("*"), F.coalesce(inside, F.lit(0))).first()
    return F.broadcast(df) if rows * row_bytes + elements * item_bytes <= BROADCAST_BYTES else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """Hint joins of this frame to shuffle both sides and broadcast neither.

    For joins with a frame made by an explode: Spark sizes it by the table below, without the rows that the explode adds,
    so it may broadcast (and collect on the driver) many times what its threshold allows.
    """
    return df.hint("merge")


def doc_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, th) of a document table: the columns by which rows are told apart.

    ``th`` hashes the text (null as empty), so that rows with a null or repeated doc_id but different texts stay
    different documents. Rows that agree in both are copies of one document.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def same_doc(a: DataFrame, b: DataFrame) -> Column:
    """The join condition on (doc_id, th), null ids included."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def keyed(docs: DataFrame) -> DataFrame:
    """The rows of a document table as (r, doc_id, th): ``r`` holds all their columns, so that no name can clash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"),
                       F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"))


def columns_of(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``keyed`` rows as they were, but for those that are changed."""
    return [changed[c].alias(c) if c in changed else F.col(f"r.`{c}`") for c in docs.columns]


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, th) is not in ``bad``, with their own columns only."""
    rows = keyed(docs)
    return rows.join(bad, same_doc(rows, bad), "left_anti").select(*columns_of(docs))


def connected_components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """Connected components of an undirected edge list: (node, root), root the smallest node of the component.

    Alternates large-star and small-star steps: each is an aggregate (combined on the map side, so a node of high
    degree costs one row per task) and a join on the node. Each step's edges are written to the shared folder; only
    a count and a checksum of them reach the driver. Nodes without an edge are not in the result; self links and
    null ends are ignored. An empty edge list gives an empty result.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _checksum(e)
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct(), name)
        now = _checksum(e)
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)
