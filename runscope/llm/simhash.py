"""SimHash near-duplicates by multi-index hashing (operator 7).

A fingerprint has two 32-bit segments. Two fingerprints at MAX_BITS = 3 or fewer bits agree in one segment but for one
bit at most. So each fingerprint is stored under its two segments and looks up the Hamming ball of radius 1 around
them; of a pair one bit apart, exactly one side has a 0 there, so setting zero bits enumerates half of the ball and
still finds every pair. Matches are verified on all 64 bits.

Table entries with more than HOT_ENTRIES rows are not compared pair by pair. They are indexed once more, by points of
the other segment: members within a small ball around the same point link to one centre (see ``_hot_links``), which
gives the same components with rows in proportion to the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import connected_components, cut, doc_rows, map_batches, shuffled, texts, without

SHINGLE_WORDS, MAX_BITS, SEED = 3, 3, 42
#: Rows of one table entry that are compared pair by pair; larger entries take the ball index.
HOT_ENTRIES = 64


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as an unsigned number: bit i is 1 if over half of the shingles' XXH64 values have it.

    Words are split at ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle; a text
    without words has fingerprint 0.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle_words:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle_words)))]
    ones = np.zeros(64, np.int64)
    h = np.array(hashes, dtype="<u8")
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


_OUT = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])


def _fingerprints(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in texts(batch)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"),
                                              pa.array(fps.view(np.int64))], schema=_OUT)
    return run


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, th, fp): one row per document row, fp as a signed long."""
    return map_batches(doc_rows(docs), _fingerprints(shingle_words), "doc_id long, th long, fp long")


#: For a fingerprint: its segment s under key (s, value) as an entry, and with one zero bit set as look-ups.
_KEYS = """
flatten(transform(sequence(0, 1), s -> transform(
  filter(sequence(-1, 31), b -> b < 0 OR (shiftright(fp, 32 * s + greatest(b, 0)) & 1L) = 0L),
  b -> struct((((shiftrightunsigned(fp, 32 * s) & 4294967295L) | IF(b < 0, 0L, shiftleft(1L, greatest(b, 0))))
               | shiftleft(CAST(s AS bigint), 32)) AS key, b < 0 AS entry))))
"""


def links(nodes: DataFrame, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs within MAX_BITS bits do.

    ``nodes`` is (fp): distinct fingerprints, signed.
    """
    keys = nodes.select("fp", F.explode(F.expr(_KEYS)).alias("k")).select("fp", "k.key", "k.entry")
    used = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("entry").alias("has")).where("n > 1 AND has")
    met = cut(keys.join(shuffled(used.select("key", "n")), "key"), "simhash-met")

    cold, hot = met.where(F.col("n") <= hot_entries), met.where(F.col("n") > hot_entries)
    entry = cold.where("entry").select("key", F.col("fp").alias("a"))
    other = cold.select("key", F.col("fp").alias("b"), "entry")
    # Two entries of one key meet once; an entry and a look-up always.
    pairs = entry.join(other, "key").where("NOT entry OR a < b")
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    return pairs.select("a", "b").union(_hot_links(hot))


def _hot_links(hot: DataFrame) -> DataFrame:
    """Links in large table entries, by points x of the other segment o.

    For one key and point x let C be the entries with d(o, x) <= 1. Any entry with d(o, x) <= 2 is within 3 bits of
    any of C (same segment), and so is any look-up with d(o, x) <= 1 (one bit of the segment, two of the rest). All
    of them link to one member of C. Every pair to be found has such a point between its two sides.
    """
    o = "(shiftrightunsigned(fp, IF(key < 4294967296L, 32, 0)) & 4294967295L)"
    one = f"transform(sequence(0, 31), i -> struct(({o} ^ shiftleft(1L, i)) AS x, 1 AS d))"
    two = (f"flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), "
           f"j -> struct(({o} ^ shiftleft(1L, i) ^ shiftleft(1L, j)) AS x, 2 AS d))))")
    near = f"concat(array(struct({o} AS x, 0 AS d)), {one})"
    points = hot.select("key", "fp", "entry", F.explode(F.expr(
        f"IF(entry, concat({near}, {two}), {near})")).alias("p")).select("key", "fp", "entry", "p.x", "p.d")
    centres = points.where("entry AND d <= 1").groupBy("key", "x").agg(F.min("fp").alias("c"))
    found = points.join(shuffled(centres), ["key", "x"]).where("fp <> c")
    found = found.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("c"))) <= MAX_BITS)
    return found.select(F.col("fp").alias("a"), F.col("c").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """One row per document row: doc_id, th, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest doc_id that can be reached over links of MAX_BITS or fewer bits, the document itself
    included; equal fingerprints, that of texts without words too, are linked. Rows with a null doc_id carry no name:
    they get the component of the documents that they link to, null if there is none. Rows of one doc_id are one
    document (their links are joined). An empty table gives an empty result.
    """
    return _components(docs, shingle_words, hot_entries).drop("root")


def _components(docs: DataFrame, shingle_words: int, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """The rows of ``near_duplicates`` with the root of their component, which those without any doc_id have too."""
    prints = cut(fingerprints(docs, shingle_words), "simhash-prints")
    # Copies, however many, are one fingerprint from here on.
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    # Rows of one doc_id with different texts tie their fingerprints together.
    ids = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    tied = prints.select("doc_id", "fp").join(ids.where("a <> b").select("doc_id", "a"), "doc_id")
    roots = connected_components(links(classes.select("fp"), hot_entries).union(tied.select("a", "fp")), "a", "b",
                                 "simhash-components")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left")
    rooted = cut(rooted.select("fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    rooted = rooted.join(named, "root").select("fp", "component_id", "root")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(rooted, "fp").select("doc_id", "th", hexed.alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each component: that with the smallest doc_id; all columns as they were.

    Rows that can't be told from it (same doc_id and text) count as one document and stay. Of a component without
    any doc_id, the rows of the smallest text hash stay.
    """
    found = cut(_components(docs, shingle_words).drop("fingerprint"), "simhash-found")
    drop = found.where("component_id IS NOT NULL AND NOT (doc_id <=> component_id)").select("doc_id", "th")
    # The id that stays may have rows of several texts: those of the smallest hash stay.
    stays = found.where("doc_id = component_id").select("doc_id", "th")
    kept = stays.groupBy("doc_id").agg(F.min("th").alias("kept"))
    drop = drop.union(stays.join(kept, "doc_id").where("th <> kept").select("doc_id", "th"))
    nameless = found.where("component_id IS NULL").select("doc_id", "th", "root")
    first = nameless.groupBy("root").agg(F.min("th").alias("kept"))
    drop = drop.union(
        nameless.join(first, "root").where("th <> kept").select("doc_id", "th"))
    return without(docs, cut(drop.distinct(), "simhash-drop"))
