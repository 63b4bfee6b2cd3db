"""Benchmark decontamination by winnowing (operator 5), in DataFrame functions only.

Of every ``SPAN`` consecutive words, the smallest of the k-gram hashes is kept, for documents and items alike, so
that a shared span of WINDOW = k + SPAN_GRAMS - 1 words or more always shares a kept hash. Documents and items meet
on kept hashes; then each hit is extended along its diagonal (place in the document less place in the item): the
item's words there are joined word by word with the document's, and runs of WINDOW equal words are occurrences. Words
of one place are rows of their own, so nothing is copied for each hit, however often a text repeats itself.
Items with fewer words than a window are one window each; they meet on the hash of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import ascii_lower, cut, doc_rows, same_doc, shuffled, small, without

#: Words of a window, words of a hashed k-gram, k-grams of which the smallest hash is kept.
WINDOW, K = 10, 5
SPAN_GRAMS = WINDOW - K + 1

#: ASCII letters and digits, and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _grams(hashes: str, k: int) -> Column:
    """Hash of each k consecutive word hashes of the array column."""
    parts = ", ".join(f"{hashes}[i + {j}]" if j else f"{hashes}[i]" for j in range(k))
    return F.expr(f"CASE WHEN size({hashes}) >= {k} THEN transform(sequence(0, size({hashes}) - {k}), "
                  f"i -> xxhash64({parts})) ELSE array() END")


def _kept(grams: str) -> Column:
    """The smallest hash of each SPAN_GRAMS consecutive ones, each value once."""
    least = ", ".join(f"{grams}[i + {j}]" if j else f"{grams}[i]" for j in range(SPAN_GRAMS))
    return F.expr(f"CASE WHEN size({grams}) >= {SPAN_GRAMS} THEN array_distinct(transform("
                  f"sequence(0, size({grams}) - {SPAN_GRAMS}), i -> least({least}))) ELSE array() END")


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, iw, m, k, marks): marks are the (q, h) places and hashes by which documents find the item."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                            word_array(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("iw"))
    rows = rows.where(F.col("item_id").isNotNull() & (F.size("iw") > 0)).distinct()
    rows = rows.select(F.xxhash64("item_id", "iw").alias("item"), "item_id", "iw", F.size("iw").alias("m"),
                       F.expr("transform(iw, w -> xxhash64(w))").alias("wh"))
    rows = rows.withColumn("g", _grams("wh", K)).withColumn("kept", _kept("g"))
    long_marks = "filter(transform(g, (h, q) -> struct(q AS q, h AS h)), x -> array_contains(kept, x.h))"
    return rows.select("item", "item_id", "iw", "m", F.expr(f"IF(m >= {WINDOW}, {K}, m)").alias("k"), F.expr(
        f"CASE WHEN m >= {WINDOW} THEN {long_marks} ELSE array(struct(0 AS q, xxhash64(wh) AS h)) END").alias("marks"))


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row: doc_id, th (text hash), n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. A document word is hit
    if it lies in an occurrence of a window (WINDOW consecutive words of one item). n_items counts the items with an
    occurring window; items_sha256 is over their ids, sorted as strings and joined by commas. Null texts have no
    words; items with a null id or without words take no part; repeated item ids count once; document rows that agree
    in doc_id and text get the same values each. Empty tables on either side give rows without hits, or no rows.
    """
    items = cut(_items(benchmark), "decontam-items")
    # Lengths under WINDOW only: nine values at most.
    short = sorted(r[0] for r in items.where(F.col("m") < WINDOW).select("m").distinct().collect())

    hashed = doc_rows(docs).select("doc_id", "th", word_array(F.col("text")).alias("w"))
    hashed = hashed.select("doc_id", "th", F.expr("transform(w, x -> xxhash64(x))").alias("wh"))
    grams = hashed.select("doc_id", "th", "wh", _grams("wh", K).alias("g"))
    marks = [_kept("g")] + [F.array_distinct(_grams("wh", m)) for m in short]
    prints = cut(grams.select("doc_id", "th", F.size("wh").cast("long").alias("n_words"),
                              (F.concat(*marks) if short else marks[0]).alias("prints")), "decontam-prints")

    # Which documents share a kept hash with an item.
    marks_of = items.select("item", "k", F.explode("marks").alias("x")).select("item", "k", "x.q", "x.h")
    marks_of = small(cut(marks_of, "decontam-marks"), 40)
    found = prints.select("doc_id", "th", F.explode("prints").alias("h")).join(marks_of.select("h"), "h", "left_semi")
    found = cut(found.select("doc_id", "th").distinct().withColumn("no", F.monotonically_increasing_id()),
                "decontam-found")

    # Their words, once for each document.
    near = doc_rows(docs)
    near = near.join(small(found, 40), same_doc(near, found)).select("no", word_array(F.col("text")).alias("w"))
    near = cut(near.dropDuplicates(["no"]), "decontam-near")
    grams = near.select("no", F.expr("transform(w, x -> xxhash64(x))").alias("wh"))
    places = [F.struct(F.lit(k).alias("k"), _grams("wh", k).alias("g")) for k in [K, *short]]
    grams = grams.select("no", F.inline(F.array(*places))).select("no", "k", F.posexplode("g").alias("p", "h"))

    # Extend: on each diagonal of a hit, the item's words that the document has at their place; runs of l of them.
    diagonals = grams.join(marks_of, ["k", "h"]).select("no", "item", (F.col("p") - F.col("q")).alias("d")).distinct()
    words = small(items.select("item", F.least("m", F.lit(WINDOW)).alias("l"), F.posexplode("iw").alias("q", "word")),
                  64)
    lined_up = diagonals.join(words, "item").withColumn("pos", F.col("d") + F.col("q"))
    in_docs = near.select("no", F.posexplode("w").alias("pos", "word"))
    equal = lined_up.join(shuffled(in_docs), ["no", "pos", "word"]).groupBy("no", "item", "d", "l").agg(
        F.array_sort(F.collect_list("q")).alias("at"))
    starts = equal.where(F.size("at") >= F.col("l")).select("no", "item", "l", F.explode(F.expr(
        "transform(filter(sequence(0, size(at) - l), i -> at[i + l - 1] = at[i] + l - 1), i -> d + at[i])")).alias("s"))
    # Words in the union of a document's windows: each adds what lies beyond the ends of those that start before it.
    spans = starts.groupBy("no").agg(F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("l")).alias("e"))))
                                     .alias("spans"), F.collect_set("item").alias("hit_items"))
    n_hit = F.expr("aggregate(spans, struct(0 AS e, 0L AS n), (a, x) -> struct(greatest(a.e, x.e) AS e, "
                   "a.n + greatest(0, x.e - greatest(a.e, x.s)) AS n)).n")
    hits = cut(spans.select("no", n_hit.alias("n_hit"), "hit_items"), "decontam-spans")
    names = small(items.select("item", "item_id"), 64)
    ids = hits.select("no", F.explode("hit_items").alias("item")).join(names, "item")
    ids = ids.groupBy("no").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    hits = found.join(hits.select("no", "n_hit"), "no").join(ids, "no").select("doc_id", "th", "n_hit", "ids")
    hits = cut(hits, "decontam-hits")

    out = prints.join(hits, same_doc(prints, hits), "left")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(prints["doc_id"], prints["th"], "n_words", n_hit.alias("n_hit"),
                      F.size(ids).cast("long").alias("n_items"),
                      F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The document rows without a hit, all columns as they were."""
    bad = cut(find_contamination(docs, benchmark).where("contaminated").select("doc_id", "th").distinct(),
              "decontam-bad")
    return without(docs, bad)
