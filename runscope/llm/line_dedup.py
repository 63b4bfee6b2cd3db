"""Line deduplication within an edit bound by a deletion-neighbourhood join (operator 3).

Lines are compared by content: runs of ASCII white space as one space, none at the ends. Of equal lines the earliest
stays (smallest doc_id, then line number). A line also goes if an earlier line, of other content, is within the bound
(characters put in, left out or replaced).

Two lines are within k edits if some r characters of each are replaced, and some of each are left out, k in all. So
all variants of a line with r characters masked and d left out are hashed; equal variants are joined, and met pairs
are verified by their edit distance. Where both sides leave out as many, any two lines of a variant are within the
bound, so its earliest line stands for all; else the two sides meet by their earliest lines, too. No group of lines
is ever paired in full. Most lines can't have a partner: of k + 1 segments one stays as it is, so only lines that
share a segment, at fitting lengths and places, with another one emit their variants. That filter loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import columns_of, cut, doc_rows, keyed, map_batches, same_doc, shuffled, small, texts

#: Edits within which two lines count as one. A line of n characters has about (2n)**k variants for k edits.
MAX_EDITS = 1
#: Variants hashed at once, for more than one edit.
VARIANTS = 1 << 16
#: Characters hashed at once in a worker.
CHUNK_CHARS = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(v: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


class Prefixes:
    """Hashes of substrings of many lines, from the prefix sums of a polynomial modulo 2**64."""

    def __init__(self, lines: list[str]):
        chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.lengths = np.array([len(x) for x in lines], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if lines else \
            np.zeros(0, np.int64)
        values = _mixed(chars + np.uint64(1)) * _powers(_BASE, len(chars))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        self.inverse = _powers(_INVERSE, len(chars) + 1)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the characters from a to b, wherever they stand."""
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def segments(self, k: int) -> np.ndarray:
        """Keys of segments: two lines within k edits share one. The shorter line's length m is cut into k + 1
        segments; one of them stands in the longer line as it is, moved by as many places as the edits on its left,
        and those on its right, allow."""
        keys, n = [], self.lengths
        for less in range(k + 1):
            m = np.maximum(n - less, 0)
            for i in range(k + 1):
                first, size = i * m // (k + 1), (i + 1) * m // (k + 1) - i * m // (k + 1)
                for moved in range(max(-i, less - (k - i)), min(i, less + k - i) + 1):
                    at = self.starts + np.clip(first + moved, 0, n - size)
                    h = self.between(at, at + size)
                    keys.append(_mixed(h ^ _mixed(((k + 1) * m + i).astype(np.uint64))))
        return np.stack(keys, axis=1)

    def without(self, i: int, places: np.ndarray) -> np.ndarray:
        """Hashes of line i without the characters at each row's ascending places."""
        start, n = int(self.starts[i]), int(self.lengths[i])
        total, before = np.zeros(len(places), np.uint64), np.full(len(places), start)
        factor = np.ones(1, np.uint64)
        for column in places.T:
            total += factor * (self.sums[start + column] - self.sums[before])
            before, factor = start + column + 1, factor * _INVERSE
        return (total + factor * (self.sums[start + n] - self.sums[before])) * self.inverse[start]

    def variants(self, i: int, masked: int, left_out: int) -> Iterator[np.ndarray]:
        """Keys of line i's variants with so many characters masked and so many left out."""
        n, count = int(self.lengths[i]), masked + left_out
        for places in _choices(n, count):
            h = self.without(i, places)
            for masks in combinations(range(count), masked):
                key = _mixed(np.uint64(n - left_out) ^ np.uint64(masked << 56) ^ _mixed(h))
                for c in masks:  # where the mask stands in the variant: after the characters that stay before it
                    gone = sum(1 for x in range(c) if x not in masks)
                    key = _mixed(key + (places[:, c] - gone).astype(np.uint64) * _BASE)
                yield key


def _choices(n: int, count: int) -> Iterator[np.ndarray]:
    """All choices of so many of n places, ascending, as rows."""
    if count <= 1:
        yield np.arange(n)[:, None] if count else np.zeros((1, 0), np.int64)
        return
    held, size = [], 0
    for first in range(n):
        for rest in _choices(n - first - 1, count - 1):
            held.append(np.concatenate([np.full((len(rest), 1), first), rest + first + 1], axis=1))
            size += len(rest)
            if size >= VARIANTS:
                yield np.concatenate(held)
                held, size = [], 0
    if size:
        yield np.concatenate(held)


def classes_of(k: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """(masked, left out) where both sides leave out as many; (masked, left out by the longer, by the shorter line)."""
    even = [(k - 2 * d, d) for d in range(k // 2 + 1)]
    return even, [(k - a - b, a, b) for a in range(1, k + 1) for b in range(min(a, k - a + 1)) if a + b <= k]


def within_edits(a: str, b: str, k: int) -> bool:
    """Whether two texts are within k edits, in a time that grows with their length (and threefold with each edit)."""
    if abs(len(a) - len(b)) > k:
        return False
    at = _common(a, b)
    a, b = a[at:], b[at:]
    if not a or not b:
        return len(a) + len(b) <= k
    if k == 0:
        return False
    return within_edits(a[1:], b[1:], k - 1) or within_edits(a[1:], b, k - 1) or within_edits(a, b[1:], k - 1)


def _common(a: str, b: str) -> int:
    """Length of the common beginning, found by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:  # a and b agree up to low, and not up to high
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def content(line: str) -> str:
    """The line as it is compared."""
    return b" ".join(line.encode("utf-8", "surrogatepass").split()).decode("utf-8", "surrogatepass")


_LINE = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("line_no", pa.int32()), ("digest", pa.binary()),
                   ("segments", pa.list_(pa.int64()))])
_NEAR = pa.schema([("rank", pa.int64()), ("line", pa.string()), ("even", pa.list_(pa.int64())),
                   ("longer", pa.list_(pa.int64())), ("shorter", pa.list_(pa.int64()))])


def _in_chunks(rows: Iterator[tuple], size) -> Iterator[list[tuple]]:
    chunk, chars = [], 0
    for row in rows:
        chunk.append(row)
        chars += size(row)
        if chars >= CHUNK_CHARS:
            yield chunk
            chunk, chars = [], 0
    if chunk:
        yield chunk


def _lines(max_edits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest

        def rows(batch):
            for doc_id, th, text in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(),
                                        texts(batch)):
                for no, line in enumerate(text.split("\n")):
                    if line and (line := content(line)):
                        yield doc_id, th, no, line
        for batch in batches:
            for chunk in _in_chunks(rows(batch), lambda r: len(r[3])):
                lines = [r[3] for r in chunk]
                keys = Prefixes(lines).segments(max_edits).view(np.int64).tolist() if max_edits else []
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in chunk], pa.int64()), pa.array([r[1] for r in chunk], pa.int64()),
                    pa.array([r[2] for r in chunk], pa.int32()),
                    pa.array([digest(x.encode("utf-8", "surrogatepass")) for x in lines], pa.binary()),
                    pa.array([keys[i] if max_edits and len(x) >= min_chars else [] for i, x in enumerate(lines)],
                             pa.list_(pa.int64()))], schema=_LINE)
    return run


def _variants(max_edits: int):
    even, uneven = classes_of(max_edits)

    def parts(sums: Prefixes, i: int) -> Iterator[tuple]:
        for masked, left_out in even:
            for keys in sums.variants(i, masked, left_out):
                yield keys, _NO_KEYS, _NO_KEYS
        for masked, more, fewer in uneven:
            for keys in sums.variants(i, masked, more):
                yield _NO_KEYS, _mixed(keys + np.uint64(more)), _NO_KEYS
            for keys in sums.variants(i, masked, fewer):
                yield _NO_KEYS, _NO_KEYS, _mixed(keys + np.uint64(more))

    def rows_of(rank: int, line: str, sums: Prefixes, i: int) -> Iterator[tuple]:
        """The line's variants, in rows of VARIANTS or a little more; the line itself stands in the last one."""
        held, size = [], 0
        for part in parts(sums, i):
            held.append(part)
            size += sum(map(len, part))
            if size >= VARIANTS:
                yield rank, None, *(np.concatenate(x).view(np.int64) for x in zip(*held))
                held, size = [], 0
        yield rank, line, *(np.concatenate([_NO_KEYS, *x]).view(np.int64) for x in zip(*(held or [[_NO_KEYS] * 3])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def rows():
                for text, wanted in zip(texts(batch), batch.column("wanted").to_pylist()):
                    lines = text.split("\n")
                    for w in wanted:
                        yield w["rank"], content(lines[w["line_no"]])
            for chunk in _in_chunks(rows(), lambda r: 24 * len(r[1])):
                sums, held, size = Prefixes([r[1] for r in chunk]), [], 0
                for i, (rank, line) in enumerate(chunk):
                    for row in rows_of(rank, line, sums, i):
                        held.append(row)
                        size += sum(map(len, row[2:]))
                        if size >= CHUNK_CHARS:
                            yield _near_batch(held)
                            held, size = [], 0
                if held:
                    yield _near_batch(held)
    return run


_NO_KEYS = np.zeros(0, np.uint64)


def _near_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _NEAR)], schema=_NEAR)


def _verified(max_edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [within_edits(a, b, max_edits) for a, b in zip(batch.column("late_line").to_pylist(),
                                                                  batch.column("early_line").to_pylist())]
            yield batch.select(["rank"]).filter(pa.array(near, pa.bool_()))
    return run


def _near_classes(docs: DataFrame, classes: DataFrame, max_edits: int) -> DataFrame:
    """Digests of contents that are within the bound of the content of an earlier line."""
    # Only contents that share a segment with another one can have a partner. A segment that very many contents share
    # is two values of an aggregate, not a group.
    keys = classes.select(F.xxhash64("digest").alias("id"), F.explode("segments").alias("segment"))
    shared = keys.groupBy("segment").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    met = keys.join(shuffled(shared), "segment", "left_semi").select("id").distinct()
    able = classes.where(F.size("segments") > 0).withColumn("id", F.xxhash64("digest")).join(met, "id", "left_semi")
    able = cut(able.select("digest", "first"), "lines-able")
    # Numbers in the order of the first places: a distributed sort, then ids that ascend with the partitions.
    able = cut(able.orderBy("first").withColumn("rank", F.monotonically_increasing_id()), "lines-ranked")

    # Their texts, and the keys of their variants.
    wanted = cut(able.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th")).agg(
        F.collect_list(F.struct("first.line_no", "rank")).alias("wanted")), "lines-wanted")
    rows, found = doc_rows(docs), small(wanted, 40, "wanted", 32)
    asked = rows.join(found, same_doc(rows, found)).select("text", "wanted")
    near = cut(map_batches(asked, _variants(max_edits), "rank long, line string, even array<long>, "
                           "longer array<long>, shorter array<long>"), "lines-near")

    # Both sides leave out as many characters: the earliest of such a group is within the bound of all. Nearly all
    # groups that are left have two members; larger ones are looked up once more.
    even = near.select(F.explode("even").alias("key"), "rank")
    groups = cut(even.groupBy("key").agg(F.min("rank").alias("early"), F.max("rank").alias("late"),
                                         F.count("*").alias("n")).where("early < late"), "lines-groups")
    large = small(groups.where("n > 2").select("key", "early"), 24)
    pairs = groups.where("n = 2").select("late", "early").union(
        even.join(large, "key").where("early < rank").select(F.col("rank").alias("late"), "early"))
    # One side leaves out more. Variants of the longer lines that meet a shorter one are few; then each line looks for
    # the earliest one of the other side.
    longer = near.select(F.explode("longer").alias("key"), "rank")
    shorter = near.select(F.explode("shorter").alias("key"), "rank")
    first = cut(shorter.groupBy("key").agg(F.min("rank").alias("early")), "lines-shorter")
    met = cut(longer.join(small(first, 24), "key"), "lines-longer")
    back = met.groupBy("key").agg(F.min("rank").alias("early"))
    pairs = pairs.union(met.where("early < rank").select(F.col("rank").alias("late"), "early")).union(
        shorter.join(small(cut(back, "lines-back"), 24), "key").where("early < rank").select(
            F.col("rank").alias("late"), "early")).distinct()

    line = near.where("line IS NOT NULL").select(F.col("rank").alias("late"), F.col("line").alias("late_line"))
    early = line.select(F.col("late").alias("early"), F.col("late_line").alias("early_line"))
    pairs = pairs.join(line.dropDuplicates(["late"]), "late").join(early.dropDuplicates(["early"]), "early")
    within = map_batches(pairs.select(F.col("late").alias("rank"), "late_line", "early_line"), _verified(max_edits),
                         "rank long").distinct()
    return cut(able.join(within, "rank", "left_semi").select("digest"), "lines-within")


def _shortest(max_edits: int, min_chars: int | None) -> int:
    """The least length of near lines: more characters must stay than the edits of both lines can touch."""
    return max(2 * max_edits + 1, min_chars or 0)


def dropped_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int | None = None) -> DataFrame:
    """(doc_id, th, dropped): for each document that loses lines, their numbers (from 0), in a written table."""
    lines = cut(map_batches(doc_rows(docs), _lines(max_edits, _shortest(max_edits, min_chars)),
                            "doc_id long, th long, line_no int, digest binary, segments array<long>"), "lines")
    at = F.struct("doc_id", "th", "line_no")
    classes = cut(lines.groupBy("digest").agg(F.min(at).alias("first"), F.count("*").alias("n_lines"),
                                              F.first("segments").alias("segments")), "line-classes")
    within = _near_classes(docs, classes, max_edits) if max_edits else classes.select("digest").limit(0)
    within = within.withColumn("near", F.lit(True))
    # Only contents with a copy or an earlier near copy have lines to drop.
    bad = classes.join(within, "digest", "left").where("n_lines > 1 OR near").select("digest", "first", "near")
    gone = lines.join(bad, "digest").where("near OR first < struct(doc_id, th, line_no)")
    return cut(gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("dropped")),
               "lines-dropped")


def _kept(lines: str) -> Column:
    """The lines that are not dropped, by their numbers; linear in the lines, however many go."""
    kept = f"array_except(sequence(0, size({lines}) - 1), dropped)"
    return F.expr(f"array_join(transform({kept}, i -> {lines}[i]), '\n')")


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int | None = None) -> DataFrame:
    """The document rows without the lines that repeat an earlier one; all other columns as they were.

    n_chars, where there is one, counts the new text. Lines are cut at line feeds. Lines without content are never
    dropped. Lines of up to twice ``max_edits`` characters are dropped for equality only: within so many edits any two
    of them would be the same; ``min_chars`` raises that length. Rows that agree in doc_id
    and text are one document and keep the same lines; null ids come before all others. A document whose lines are
    all dropped keeps its row with an empty text; a null text stays null.
    """
    rows, gone = keyed(docs), small(dropped_lines(docs, max_edits, min_chars), 40, "dropped", 4)
    joined = rows.join(gone, same_doc(rows, gone), "left").select("r", "dropped")
    joined = joined.withColumn("lines", F.when(F.col("dropped").isNotNull(), F.split("r.text", "\n", -1)))
    text = F.when(F.col("dropped").isNull(), F.col("r.text")).otherwise(_kept("lines"))
    joined = joined.select("r", text.alias("new_text"))
    changed = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("r.text").isNull() | F.col("r.text").eqNullSafe(F.col("new_text")),
                                    F.col("r.n_chars")).otherwise(F.char_length("new_text").cast(kind))
    return joined.select(*columns_of(docs, **changed))


def line_report(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int | None = None) -> DataFrame:
    """One row per document row: doc_id, n_lines, n_dropped, dropped (line numbers), text (the lines that stay).

    Same rules as ``dedup_lines``; a null text has no lines and stays null.
    """
    gone = small(dropped_lines(docs, max_edits, min_chars), 40, "dropped", 4)
    rows = keyed(docs)
    joined = rows.join(gone, same_doc(rows, gone), "left").select(
        rows["doc_id"], F.col("r.text").cast("string").alias("old"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    joined = joined.withColumn("lines", F.split("old", "\n", -1))
    return joined.select(
        "doc_id", F.when(F.col("old").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"), "dropped",
        _kept("lines").alias("text"))
