"""Token counts through a digest cache (operator 2).

The cache is a table (content digest, tokenizer digest, n_tokens) in a shared folder. Counting a table means: digest
its normalised texts, drop the digests that the cache has for this tokenizer, encode one text for each of the rest,
append their counts, and join the table with the cache.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import cut, map_batches, scratch_path, texts, worker_memo

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
_ARROW = pa.schema([("digest", pa.binary()), ("tokenizer", pa.string()), ("n_tokens", pa.int64())])

#: Words kept in a worker's memo before it starts afresh, and the longest word kept.
MEMO_ENTRIES, MEMO_CHARS = 300_000, 64
_SPACE = re.compile(r"[ \t\n\r]+")


def normalised(text: Column) -> Column:
    """Null as empty; runs of spaces, tabs and line ends as one space, none at the ends.

    For tokenizers that drop white space this leaves the count as it is, and texts that differ in nothing else share
    one entry of the cache.
    """
    t = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[ \t\n\r]{2,}|[\t\n\r]", " ")
    return F.trim(t)


class WordCounter:
    """Counts of a tokenizer that drops white space: no token spans a space, so words are counted one by one."""

    def __init__(self, tokenizer: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(tokenizer.decode())
        tok.no_truncation()
        tok.no_padding()
        self._tok, self._memo = tok, {"": 0}

    def _count(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self._tok.encode_batch_fast(words, add_special_tokens=False)]

    def __call__(self, text: str) -> int:
        words = _SPACE.split(text) if "\n" in text or "\t" in text or "\r" in text else text.split(" ")
        memo, own = self._memo, set(words)
        missing = [w for w in own if w not in memo]
        if len(memo) + len(missing) > MEMO_ENTRIES:
            memo.clear()
            memo[""] = 0
            missing = [w for w in own if w]
        extra = {}
        if missing:
            for w, n in zip(missing, self._count(missing)):
                (memo if len(w) <= MEMO_CHARS else extra)[w] = n
        if extra:
            return sum(memo[w] if w in memo else extra[w] for w in words)
        return sum(map(memo.__getitem__, words))


def _encode(tokenizer: bytes, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker_memo("counts " + version, lambda: WordCounter(tokenizer))
        for batch in batches:
            n = [count(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(n), pa.string()),
                                              pa.array(n, pa.int64())], schema=_ARROW)
    return run


def _read_cache(spark, path: str, version: str) -> DataFrame:
    """Counts by digest; entries that two runs appended at the same time agree, one of them is taken."""
    cache = spark.read.schema(CACHE_SCHEMA).parquet(path)
    return cache.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: bytes, cache_path: str | None = None, limit: int = 2048) -> DataFrame:
    """One row per document row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``tokenizer`` is the content of a tokenizers .json file whose pre-tokenizer drops white space. ``cache_path`` is
    the cache table to use and to append to; without it, a new one below the shared folder. Null texts count as
    empty (0 bytes, 0 tokens). Columns other than doc_id and text are not read; null and repeated ids stay as they
    are. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    version = hashlib.sha256(tokenizer).hexdigest()
    cache_path = cache_path or scratch_path(spark, "token-cache")
    # An empty append makes the table, if it isn't there.
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text).alias("text"),
                       F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    keys = cut(rows.select("doc_id", "n_bytes", "digest"), "token-keys")

    # One document stands for each digest that is not in the cache. Copies are dropped by an aggregate over digests
    # (combined on the map side) before any text moves; then the texts meet their digests on a key without skew.
    # Where rows repeat both the id and the text of the stand-in, one of them is taken before it is encoded.
    alike = keys.groupBy("digest", "doc_id").agg(F.count("*").alias("same"))
    misses = alike.groupBy("digest").agg(F.min(F.struct("doc_id", "same")).alias("m"))
    misses = misses.select("digest", "m.doc_id", "m.same")
    misses = cut(misses.join(_read_cache(spark, cache_path, version), "digest", "left_anti"), "token-misses")

    def met(some: DataFrame) -> DataFrame:
        same = rows["doc_id"].eqNullSafe(some["doc_id"]) & (rows["digest"] == some["digest"])
        return rows.join(some, same, "left_semi").select("digest", "text")

    repeated = misses.where("same > 1")
    todo = met(misses.where("same = 1"))
    if repeated.limit(1).count():
        todo = todo.union(met(repeated).groupBy("digest").agg(F.min("text").alias("text")))
    counted = map_batches(todo, _encode(tokenizer, version), CACHE_SCHEMA)
    counted.write.mode("append").parquet(cache_path)

    # The counts of this table's digests as a table of their own: a digest that very many rows share is then one that
    # the join may split.
    cache = cut(keys.select("digest").distinct().join(_read_cache(spark, cache_path, version), "digest"),
                "token-counts")
    return keys.join(cache, "digest").select("doc_id", "n_bytes", "n_tokens",
                                             (F.col("n_tokens") > limit).alias("over_limit"))
