"""Toxicity by multiple-instance learning (operator 1).

Only documents are labelled; a document is toxic if any of its sentences is. Each sentence gets a probability from a
logistic model over its words, and the document's is their noisy-or: 1 - prod(1 - p). The model is trained on the
document labels through the noisy-or, in numpy, on a bounded sample; the sentence probabilities then tell which
sentences offend.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import cut, doc_rows, map_batches, small, texts, without

#: The training sample: at most so many labelled documents of each label, and so many bytes of their text, in the
#: order of a hash of the doc_id. Whole texts are used.
SAMPLE_DOCS, SAMPLE_BYTES = 2500, 16 << 20
#: Words kept as features: those in at least MIN_DOCS sample documents, the MAX_WORDS most telling ones.
MIN_DOCS, MAX_WORDS = 4, 4000
EPOCHS, RATE, DECAY = 300, 0.1, 3e-5
#: Besides the word itself, its beginnings of these lengths are features, so that unseen forms of a stem count.
STEMS = (3, 4, 5)
#: Words kept in a worker's memo of weights before it starts afresh.
MEMO_ENTRIES = 120_000

_ENDS = ".!?\n\r"
#: Sentence ends become line feeds, other ASCII marks spaces; the places of characters stay.
_TABLE = {c: ("\n" if chr(c) in _ENDS else " ") for c in range(128) if not chr(c).isalnum() and chr(c) != "'"}


def sentences(text: str) -> list[str]:
    """The lower-cased text cut into sentences, marks as spaces. Sentence i starts after the i sentences before it and
    an end mark each."""
    low = text.lower()
    if len(low) != len(text):  # a character whose lower case is longer: keep the places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_TABLE).split("\n")


def features(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in STEMS if len(word) > n]


class MilModel:
    """Feature weights and the sentence bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self._memo = weights, bias, {}

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def sentence_scores(self, parts: list[str]) -> np.ndarray:
        """Probability of each sentence; 0 for one without words."""
        memo = self._memo
        z = np.full(len(parts), -np.inf)
        for i, part in enumerate(parts):
            words = part.split()
            if words:
                try:
                    z[i] = self.bias + sum(map(memo.__getitem__, words))
                except KeyError:
                    if len(memo) > MEMO_ENTRIES:
                        memo.clear()
                    for w in words:
                        if w not in memo:
                            memo[w] = self.word_weight(w)
                    z[i] = self.bias + sum(map(memo.__getitem__, words))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) * np.isfinite(z)

    def score(self, parts: list[str]) -> tuple[float, np.ndarray]:
        p = self.sentence_scores(parts)
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), p


def fit(sample: list[tuple[str, int]], max_words: int = MAX_WORDS, min_docs: int = MIN_DOCS) -> MilModel:
    """Train on (text, label) pairs: full-batch Adam on the noisy-or likelihood, both labels weighing the same.

    With one label only, the model has no words and scores every document by that label's side of a half.
    """
    labels = np.array([y for _, y in sample], dtype=np.float64)
    if len(set(labels)) < 2:
        return MilModel({}, 20.0 if labels.any() else -20.0)
    seen = [Counter(), Counter()]
    for text, y in sample:
        seen[int(y)].update({f for w in set(" ".join(sentences(text)).split()) for f in features(w)})
    n = [max(1.0, float((labels == y).sum())) for y in (0, 1)]
    # Features by how far their rates of documents differ between the labels, in standard errors.
    telling = {}
    for w in seen[0].keys() | seen[1].keys():
        a, b = seen[0][w], seen[1][w]
        if a + b >= min_docs:
            rate = (a + b) / (n[0] + n[1])
            telling[w] = abs(b / n[1] - a / n[0]) / np.sqrt(rate * (1 - rate) * (1 / n[0] + 1 / n[1]) + 1e-12)
    del seen
    words = sorted(telling, key=lambda w: (-telling[w], w))[:max_words]
    index = {w: i for i, w in enumerate(words)}
    # Sentences as (sentence, feature, count) triples: numbers only, however long the texts are.
    rows, cols, counts, doc_of = array("q"), array("q"), array("d"), array("q")
    for d, (text, _) in enumerate(sample):
        for part in sentences(text):
            found = part.split()
            if found:
                for i, c in Counter(index[f] for w in found for f in features(w) if f in index).items():
                    rows.append(len(doc_of))
                    cols.append(i)
                    counts.append(float(c))
                doc_of.append(d)
    rows, cols, counts = np.array(rows, np.int64), np.array(cols, np.int64), np.array(counts)
    doc_of = np.array(doc_of, np.int64)
    balance = np.where(labels > 0, 0.5 / n[1], 0.5 / n[0])
    theta = np.zeros(len(words) + 1)
    theta[-1] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, EPOCHS + 1):
        z = theta[-1] + np.bincount(rows, counts * theta[cols], minlength=len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # log(1 - p) of sentences adds up to the log of the document's chance to be clean.
        clean = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(labels))
        toxic = -np.expm1(np.minimum(clean, -1e-9))
        # d loss / d log clean; d log(1 - p) / dz = -p
        g_doc = balance * np.where(labels > 0, (1 - toxic) / toxic, -1.0)
        g_z = g_doc[doc_of] * -p
        grad = np.concatenate([np.bincount(cols, g_z[rows] * counts, minlength=len(words)), [g_z.sum()]])
        grad[:-1] += DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return MilModel({w: float(theta[i]) for w, i in index.items() if abs(theta[i]) > 1e-3}, float(theta[-1]))


def _fitting(sized: DataFrame, max_docs: int, max_bytes: int) -> list[tuple[int, int]]:
    """(doc_id, th) of the first ``max_docs`` ids of (doc_id, th, n) rows by hash whose sizes fit what is left of
    ``max_bytes``; of an id with several texts that fit, the one of the smallest hash."""
    sized = sized.select(F.xxhash64("doc_id").alias("h"), "doc_id", "th", "n")
    picked, left, after = [], max_bytes, F.lit(True)
    while len(picked) < max_docs:
        one = sized.where(after & (F.col("n") <= left)).groupBy("h", "doc_id").agg(
            F.min(F.struct("th", "n")).alias("t"))
        rows = one.select("h", "doc_id", "t.th", "t.n").orderBy("h", "doc_id").limit(max_docs).collect()
        for r in rows:
            if r["n"] <= left and len(picked) < max_docs:
                picked.append((r["doc_id"], r["th"]))
                left -= r["n"]
        if len(rows) < max_docs:
            break
        # Rows that were passed over took no place: go on after the last one.
        after = F.struct("h", "doc_id") > F.struct(F.lit(r["h"]).cast("long"), F.lit(r["doc_id"]).cast("long"))
    if not picked:
        shortest = sized.orderBy("n", "h", "doc_id", "th").limit(1).collect()
        picked = [(r["doc_id"], r["th"]) for r in shortest]
    return picked


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each doc_id that this task meets."""
    met = set()
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        at = [i for i, d in enumerate(ids) if not (d in met or met.add(d))]
        if at:
            yield batch.take(pa.array(at))


def training_sample(docs: DataFrame, labels: DataFrame, learn, max_docs: int = SAMPLE_DOCS,
                    max_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """Whole texts and labels of at most ``max_docs`` labelled documents of each label for which ``learn`` holds.

    The ids are taken in the order of their hash; a text that does not fit what is left of its label's half of
    ``max_bytes`` is passed over, and those after it are taken. If no text of a label fits, its shortest is taken, so
    that no label is lost. Rows of one doc_id, however many, are one document: that of the smallest text hash among
    those that fit. So no more than the bounded sample reaches the driver, and it is the same however the table is
    split. Rows with a null id, text or label are left out; a doc_id with both labels counts as toxic.
    """
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & learn).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), "text")
    sized = rows.groupBy("doc_id", "th").agg(F.min(F.octet_length("text")).alias("n")).join(marked, "doc_id")
    sized = cut(sized, "toxicity-sizes")
    picked = [(*i, y) for y in (0, 1) for i in _fitting(sized.where(F.col("y") == y), max_docs, max_bytes // 2)]
    if not picked:
        return []
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, th long, y int")
    found = map_batches(rows.join(F.broadcast(ids), ["doc_id", "th"]).select("doc_id", "y", "text"), _first_of_each,
                        "doc_id long, y int, text string")
    found = found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return sorted(((r["text"], r["y"]) for r in found.select("text", "y").collect()), key=lambda x: (x[1], x[0]))


_OUT = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("score", pa.float64()), ("n_sentences", pa.int32()),
                  ("offending", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                                                    ("score", pa.float64())])))])


def _scores(model: MilModel, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts, spans = [], [], []
            for text in texts(batch):
                parts = sentences(text)
                score, p = model.score(parts)
                scores.append(score)
                counts.append(sum(1 for part in parts if part.strip()))
                found = []
                if score >= threshold:
                    limit = threshold if p.max(initial=0.0) >= threshold else p.max(initial=0.0)
                    start = 0
                    for part, s in zip(parts, p):
                        if s >= limit:
                            found.append({"start": start, "end": start + len(part), "score": float(s)})
                        start += len(part) + 1
                spans.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(scores, pa.float64()),
                 pa.array(counts, pa.int32()), pa.array(spans, _OUT.field("offending").type)], schema=_OUT)
    return run


def score_documents(docs: DataFrame, model: MilModel, threshold: float = 0.5) -> DataFrame:
    """One row per document row: doc_id, th, score, n_sentences, offending.

    score is the noisy-or of the sentence scores (0 for texts without words, null ones included). offending holds the
    character spans of the sentences that reach the threshold, for documents that do; if only many weak sentences
    together reach it, the strongest of them. Rows stay as they are: null and repeated ids too.
    """
    return map_batches(doc_rows(docs), _scores(model, threshold),
                       "doc_id long, th long, score double, n_sentences int, "
                       "offending array<struct<start: int, end: int, score: double>>")


def drop_toxic(docs: DataFrame, model: MilModel, threshold: float = 0.5) -> DataFrame:
    """The document rows whose score is below the threshold, all columns as they were."""
    bad = cut(score_documents(docs, model, threshold).where(F.col("score") >= threshold).select("doc_id", "th")
              .distinct(), "toxic")
    return without(docs, small(bad, 24))
