"""Top-k and the language model against brute force; the trained classifiers on held-out rows; the pipeline's stages."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runscope.llm import langid, ngram_lm, queries, topk, toxicity
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.llm.edge import ROWS, edge_docs, empty_docs, key
from tests.llm.test_dedup import brute_components, brute_fingerprint, words_of

VECTORS = "vec_id long, embedding array<float>, part int, kind string, score double, query_id long"


def vector_rows():
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, -0.3, 0.0, 0.25, 0.7, 2.0]) for _ in range(4)]) for i in range(60)]
    rows += [(7, list(rows[7][1])), (7, list(rows[7][1]))]  # repeated candidates count as often as they stand
    rows += [(100 + i, [1.0, 2.0]) for i in range(6)]  # another dimension, all ties
    rows += [(200, [1.0, 2.0, 3.0])]  # no candidate of its dimension
    return rows + [(300, None), (None, [1.0, 1.0, 1.0, 1.0]), (302, [1.0, None, 1.0, 1.0]),
                   (304, [float("nan"), 1.0, 1.0, 1.0]), (306, [float("inf"), 1.0, 1.0, 1.0])]


@pytest.mark.parametrize("k,tile", [(5, 4096), (3, 7)])
def test_top_k(spark, k, tile):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, "x", 0.5, 9) for r in rows], VECTORS).repartition(5)
    is_query = F.col("vec_id") % 2 == 0
    got = topk.top_k(df, is_query, k=k, query_tile=tile, shard_tile=tile, fan_in=2).collect()
    with_nums = df.select("vec_id", "embedding").collect()
    fine = [(r[0], [math.floor(256 * x) for x in r[1]]) for r in with_nums if r[0] is not None and r[1] is not None
            and all(x is not None and math.isfinite(x) for x in r[1])]
    expected = []
    for q, v in fine:
        if q % 2 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in fine if c != q and len(w) == len(v))
            expected += [(q, i + 1, c, -s) for i, (s, c) in enumerate(found[:k])]
    assert sorted(tuple(r) for r in got) == sorted(expected)
    assert topk.top_k(df.limit(0), is_query).collect() == []


def test_top_k_of_large_components(spark):
    """Scores beyond 64 bits are the largest or smallest number of 64 bits; all others are exact."""
    vectors = {0: [1e30, 1.0], 2: [-1e30, 0.0], 4: [1.0, 2.0], 6: [3e8, 1.0], 8: [1e12, -1e3], 10: [5e-1, 1.5],
               12: [1e308, 1.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(df, F.lit(True), k=9).collect()}
    most = (1 << 63) - 1
    ints = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items() if i != 12}  # 12: not finite once scaled
    assert got == {(a, b): max(-most, min(most, sum(x * y for x, y in zip(u, v))))
                   for a, u in ints.items() for b, v in ints.items() if a != b}


def lm_tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]


class BruteModel:
    """The same model from dictionaries: ``top`` are raw counts of the longest n-grams, each shorter n-gram counts the
    different words before it; those of a document's begin, which nothing precedes, keep their raw counts."""

    def __init__(self, texts, order):
        docs = [lm_tokens(t) for t in texts]
        self.order = order
        self.count = Counter(t for d in docs for t in d)
        self.grams = {n: Counter() for n in range(1, order + 1)}
        for d in docs:
            for i, w in enumerate(d):
                self.grams[min(order, i + 2)][(*self.context(d, i), w)] += 1
        for n in range(order, 1, -1):
            for g in list(self.grams[n]):
                self.grams[n - 1][g[1:]] += 1
        self.after, self.cuts = {}, {}
        for n, c in self.grams.items():
            for g, x in c.items():
                self.after.setdefault(g[:-1], []).append(x)
            self.cuts[n] = ngram_lm.discounts(*[list(c.values()).count(i) for i in (1, 2, 3, 4)])

    def context(self, d, i):
        return tuple(["<s>", *d][max(0, i + 2 - self.order):i + 1])

    def p(self, context, w):
        low = self.p(context[1:], w) if context else 1 / (len(self.count) + 1)
        after = self.after.get(context)
        if not after:
            return low
        cut = lambda c: self.cuts[len(context) + 1][min(c, 3) - 1] if c else 0.0
        c = self.grams[len(context) + 1][(*context, w)]
        return (c - cut(c) + sum(map(cut, after)) * low) / sum(after)

    def score(self, text):
        d = lm_tokens(text)
        n, v = sum(self.count.values()), len(self.count)
        return (len(d), sum(t in self.count for t in d), n,
                sum(math.log10((self.count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in d),
                sum(math.log10(self.p(self.context(d, i), w)) for i, w in enumerate(d)))


def lm_check(spark, rows, docs, learn, learns, shards, order):
    got = ngram_lm.score_documents(docs, ngram_lm.train(docs, learn, shards, order), learn).collect()
    model = BruteModel([r[1] for r in rows if learns(r)], order)
    expected = sorted([(r[0], not learns(r), *model.score(r[1])) for r in rows], key=lambda r: key(r[:4]))
    got = sorted([tuple(r)[:7] for r in got], key=lambda r: key(r[:4]))
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    by = lambda r: (key(r[:4]), r[6])
    for a, b in zip(sorted(got, key=by), sorted(expected, key=by)):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    return model


@pytest.mark.parametrize("shards,order", [(1, 2), (5, 2), (1, 3), (5, 3), (40, 3)])
def test_language_model(spark, monkeypatch, shards, order):
    """Some chunks, so that counts meet in the shards; few shards make every word frequent, many none but a few."""
    monkeypatch.setattr(ngram_lm, "CHUNK_TOKENS", 200)
    rng = random.Random(shards)
    vocabulary = [f"W{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(vocabulary[:rng.randrange(1, 31)]) for _ in range(rng.randrange(0, 25))))
            for i in range(80)]
    rows += [(80, "w1 " * 700), (81, None), (82, "never seen w1"), (84, "w2 w1 w9 " * 300), (85, "w1 unseen w2 w1 w9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = lm_check(spark, rows, docs, F.col("doc_id") % 4 != 2, lambda r: r[0] % 4 != 2, shards, order)
    for context in ("<s>",), ("w1",), ("w9",), ("w1", "w1"), ("<s>", "w2"), ("w9", "w1"):
        if len(context) < order:
            assert sum(model.p(context, w) for w in [*model.count, "unknown"]) == pytest.approx(1)


def test_language_model_packing():
    rng = random.Random(9)
    keys = np.sort(np.array([rng.getrandbits(64) for _ in range(500)], np.uint64))
    few = np.array([rng.randrange(300) for _ in range(500)], np.uint64)
    for a, b in ((keys, few), (keys[:0], few[:1])):
        steps, numbers = ngram_lm._unpacked(ngram_lm._packed(ngram_lm._steps(a), b))
        assert np.cumsum(steps, dtype=np.uint64).tolist() == a.tolist() and numbers.tolist() == b.tolist()


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_edges(spark, order):
    lm_check(spark, ROWS, edge_docs(spark), F.lit(True), lambda r: True, 3, order)
    lm_check(spark, ROWS, edge_docs(spark), F.lit(False), lambda r: False, None, order)
    empty = empty_docs(spark)
    model = ngram_lm.train(empty, F.lit(True), 2, order)
    assert ngram_lm.score_documents(empty, model, F.lit(True)).collect() == []


def test_language(spark):
    got = queries.op4_language(spark, SF_ORACLE).join(
        spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    docs = edge_docs(spark)
    got = langid.identify(docs, langid.train(docs, F.lit(True), epochs=1)).collect()
    assert sorted([(r["doc_id"], r["lang_pred"] == "und") for r in got], key=key) == sorted(
        [(r[0], not any(map(str.isalpha, r[1] or ""))) for r in ROWS], key=key)
    none = langid.train(docs, F.lit(False))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(empty_docs(spark), none).collect() == []


def test_toxicity(spark):
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet").select("doc_id", "toxic")
    got = queries.op1_toxicity(spark, SF_ORACLE).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    assert len(got) > 30 and sum(r["toxic"] == r["predicted"] for r in got) >= 0.95 * len(got)
    assert all(r["offending"] for r in got if r["predicted"])


def test_toxicity_locates_sentences():
    clean = [f"the sun is out today. we walk {w} the river! all is calm." for w in ("by", "to", "along", "past")]
    bad = [c + " you are a vile fool." for c in clean]
    model = toxicity.fit([(t, 0) for t in clean] * 3 + [(t, 1) for t in bad] * 3)
    parts = toxicity.sentences("We walk by the river. You are a vile FOOL! All is calm")
    score, p = model.score(parts)
    assert score > 0.5 and int(p.argmax()) == 1 and p[0] < 0.5 and p[2] < 0.5
    assert model.score(toxicity.sentences(clean[0]))[0] < 0.5


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    for sample in (toxicity.training_sample(docs, labels, F.lit(True)),
                   toxicity.training_sample(docs, labels.limit(0), F.lit(True)), [("only one label", 1)]):
        model = toxicity.fit(sample)
        rows = toxicity.score_documents(docs, model).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
        kept = toxicity.drop_toxic(docs, model)
        assert kept.columns == docs.columns
        assert kept.count() == sum(r["score"] < 0.5 for r in rows)
    assert toxicity.score_documents(empty_docs(spark), model).collect() == []


def test_pipeline(spark):
    """Each stage on what the one before kept, against its own rule."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination",
                            "byte_level_bpe"]
    kept = stages["toxicity"](spark, docs, SF_SMALL).cache()
    scores = {r["doc_id"]: r["score"] for r in queries.op1_toxicity(spark, SF_SMALL).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, s in scores.items() if s < 0.5}

    lines = stages["line_dedup"](spark, kept, SF_SMALL).cache()
    assert lines.columns == docs.columns and lines.count() == kept.count()

    near = stages["simhash_near_dedup"](spark, lines, SF_SMALL).cache()
    fps = [(r["doc_id"], brute_fingerprint(r["text"])) for r in lines.collect()]
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(set(brute_components(fps)))

    clean = stages["benchmark_decontamination"](spark, near, SF_SMALL).cache()
    windows = set()
    for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect():
        w = words_of(r["text"])
        windows |= {tuple(w[i:i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1)} if w else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = words_of(text)
        return any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in near.collect() if not hit(r["text"])}

    out = stages["byte_level_bpe"](spark, clean, SF_SMALL).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in out} == {
        r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in clean.collect()}
    whole = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole) == sorted((r["doc_id"], r["ids_sha256"]) for r in out)


def test_toxicity_sample_passes_over_long_texts(spark):
    texts = [(i, f"{'vile scum' if i % 2 else 'fine day'} number {i}", i % 2) for i in range(40)]
    order = [r[0] for r in spark.createDataFrame(texts, "doc_id long, text string, y int").orderBy(
        F.xxhash64("doc_id")).select("doc_id").collect()]
    first = {next(i for i in order if i % 2 == y) for y in (0, 1)}  # over budget, first of each label
    rows = [(i, t * 200 if i in first else t) for i, t, _ in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels, F.lit(True), max_bytes=4000)
    assert sorted(sample) == sorted((t, y) for i, t, y in texts if i not in first)
    # Rows that were passed over take no place in the sample.
    few = toxicity.training_sample(docs, labels, F.lit(True), max_docs=1, max_bytes=4000)
    assert [y for _, y in few] == [0, 1] and all(len(t) < 100 for t, _ in few)
    mixed = {i: "x" * (60 if k % 3 else 25) for k, i in enumerate(i for i in order if i % 2)}
    docs = spark.createDataFrame(list(mixed.items()), "doc_id long, text string")
    tight = toxicity.training_sample(docs, labels, F.lit(True), max_docs=3, max_bytes=2 * 75)
    assert sorted(len(t) for t, _ in tight) == [25, 25, 25]
    # No text of a label fits: the shortest one stands for it.
    none = toxicity.training_sample(docs, labels, F.lit(True), max_bytes=2)
    assert none == [("x" * 25, 1)]


def test_toxicity_of_one_label():
    assert toxicity.fit([("any words", 1)]).score(["other words"])[0] > 0.99
    assert toxicity.fit([("any words", 0)]).score(["other words"])[0] < 0.01


def test_samples_take_a_repeated_id_once(spark, monkeypatch):
    rows = [(i, f"text of document {i}", "en" if i % 2 else "de") for i in range(8)]
    rows += [(1, f"text of document 1, other {i % 3}", "en") for i in range(60)] + [(1, "text of document 1", "en")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels, F.lit(True), max_docs=4)
    assert sorted(y for _, y in sample) == [0] * 4 + [1] * 4  # one text each, and no other document crowded out
    assert sum(t.startswith("text of document 1") for t, _ in sample) == 1
    assert sample == toxicity.training_sample(docs.repartition(2), labels, F.lit(True), max_docs=4)
    fitted = []
    monkeypatch.setattr(langid.ByteCnn, "fit", lambda self, x, y, epochs: fitted.append((x, y)) or self)
    for parts in (6, 2):
        langid.train(docs.repartition(parts), F.lit(True))
    assert sorted(fitted[0][1].tolist()) == [0] * 4 + [1] * 4
    assert (fitted[0][0] == fitted[1][0]).all()


def test_language_learns_every_language(spark, monkeypatch):
    docs = spark.createDataFrame([(10 * i + j, f"text {j} of {i}", f"l{i:02}") for i in range(70) for j in range(3)],
                                 "doc_id long, text string, lang string")
    fitted = []
    monkeypatch.setattr(langid.ByteCnn, "fit", lambda self, x, y, epochs: fitted.append(y.tolist()) or self)
    assert langid.train(docs, F.lit(True), max_docs=2).langs == [f"l{i:02}" for i in range(70)]
    assert fitted == [[i for i in range(70) for _ in range(2)]]
