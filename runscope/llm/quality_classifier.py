"""Quality classifier: supervised subword embeddings (operator 13).

A document is the bag of its words, of its pairs of neighbouring words and of the character n-grams of its words. Each
is hashed to a bucket that has a learned vector; a document's vector is the mean over its bag, a softmax layer gives
the labels' probabilities. Vectors and layer are trained together by stochastic gradient descent in numpy, one
document a step, on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import doc_rows, map_batches, texts
from runscope.llm.toxicity import training_sample

#: The training sample: at most so many labelled documents of each label, and so many bytes of their text (half for
#: each label), in the order of a hash of the doc_id. Whole texts are used.
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 8 << 20
#: Buckets of the hashed features, components of a vector, lengths of the character n-grams.
BUCKETS, DIM, GRAMS = 1 << 17, 16, (3, 4, 5)
#: Steps in all (a small sample is gone through more often), the rate at first.
STEPS, RATE, SEED = 9_000, 0.5, 11
#: Characters that are hashed at once; a piece ends at white space.
PIECE = 1 << 19

_SPACE = re.compile(r"[\t-\r ]")
_PRIME, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Stands for the second word of a pair of equal words, whichever it is.
_AGAIN = np.uint64(0x27D4EB2F165667C5)


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes, their bits spread, as bucket numbers."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int32)


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def features(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Bucket numbers of the words, word pairs and character n-grams of a text, piece by piece.

    Words end at ASCII white space. A word's n-grams include its ends, written as spaces. In a pair, a second word
    equal to the first is one mark whichever word it is, so that repetition is learned apart from the words.
    """
    before = np.zeros(0, np.uint64)
    for piece in _pieces(text):
        words = piece.encode("utf-8", "surrogatepass").split()
        if not words:
            continue
        own = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
        yield _buckets(own * _PAIR, buckets)
        chain = np.concatenate([before, own])
        first, second = chain[:-1], chain[1:]
        again = first == second
        yield _buckets(np.where(again, _AGAIN, first * _PRIME + second), buckets)
        before = own[-1:]
        chars = np.frombuffer(f" {piece} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        blank = (chars == 32) | ((chars >= 9) & (chars <= 13))
        chars[blank] = 32
        for n in GRAMS:
            places = len(chars) - n + 1
            if places < 1:
                continue
            inside = ~blank[1:1 + places]
            for i in range(2, n - 1):
                inside &= ~blank[i:i + places]
            h = chars[:places] + np.uint64(n << 32)
            for i in range(1, n):
                h = h * _PRIME + chars[i:i + places]
            yield _buckets(h[inside], buckets)


class SubwordModel:
    """Bucket vectors and the softmax layer of ``classes`` labels, float32."""

    def __init__(self, classes: int = 2, buckets: int = BUCKETS, dim: int = DIM, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.buckets = buckets
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
        self.out = np.zeros((dim, classes), np.float32)
        self.bias = np.zeros(classes, np.float32)

    def fit(self, sample: list[tuple[str, int]], steps: int = STEPS, rate: float = RATE) -> "SubwordModel":
        """Stochastic gradient descent on (text, label) pairs, one document a step, in a drawn order; the rate falls
        to nothing. Documents of each label weigh the same in all. Texts without words are passed over."""
        bags, labels = [], []
        for text, y in sample:
            found = list(features(text, self.buckets))
            if found:
                ids, counts = np.unique(np.concatenate(found), return_counts=True)
                bags.append((ids, (counts / counts.sum()).astype(np.float32)))
                labels.append(y)
        if not bags:
            return self
        n = np.bincount(labels, minlength=len(self.bias))
        weight = (len(labels) / (np.count_nonzero(n) * np.maximum(n, 1))).astype(np.float32)
        rng = np.random.default_rng(SEED)
        order = np.concatenate([rng.permutation(len(bags)) for _ in range(-(-steps // len(bags)))])[:steps]
        for step, i in enumerate(order):
            (ids, share), y = bags[i], labels[i]
            mean = share @ self.vectors[ids]
            z = mean @ self.out + self.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            pull = np.float32(rate * (1 - step / steps)) * weight[y] * p
            back = self.out @ pull
            self.out -= np.outer(mean, pull)
            self.bias -= pull
            self.vectors[ids] -= share[:, None] * back
        return self

    def layer(self) -> np.ndarray:
        """What each bucket adds to the scores of the labels: the softmax layer is linear in the mean vector, so the
        mean may be taken after it. (buckets, classes), all that scoring needs."""
        return self.vectors @ self.out


def probabilities(text: str, layer: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The labels' probabilities of a whole text; the layer's bias alone decides on a text without words."""
    total, n = np.zeros(layer.shape[1]), 0
    for ids in features(text, len(layer)):
        total += layer[ids].sum(axis=0, dtype=np.float64)
        n += len(ids)
    z = total / max(1, n) + bias
    p = np.exp(z - z.max())
    return p / p.sum()


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", max_docs: int = SAMPLE_DOCS,
          max_bytes: int = SAMPLE_BYTES) -> SubwordModel:
    """A model of ``label`` (0 or 1) from a bounded sample of the documents for which ``learn`` holds.

    Sampling is that of operator 1: whole texts, at most ``max_docs`` documents of each label and ``max_bytes`` of
    text, the same however the tables are split; rows with a null id, text or label are left out, rows of one doc_id
    are one document, and a doc_id with both labels counts as 1. Without any labelled row the model is untrained and
    every score 0.5.
    """
    marked = labels.select("doc_id", F.col(f"`{label}`").cast("int").alias("toxic"))
    return SubwordModel().fit(training_sample(docs, marked, learn, max_docs, max_bytes))


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _scores(layer: np.ndarray, bias: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [float(probabilities(t, layer, bias)[1]) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], schema=_OUT)
    return run


def score_documents(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """One row per document row: doc_id, score (probability of label 1).

    Whole texts are scored. Null and empty texts, and texts of white space only, get the score of the layer's bias.
    Only doc_id and text are read; null and repeated ids stay as they are. An empty table gives an empty result.
    """
    return map_batches(doc_rows(docs).select("doc_id", "text"), _scores(model.layer(), model.bias.astype(np.float64)),
                       "doc_id long, score double")
