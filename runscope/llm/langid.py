"""Language identification by a byte convolutional network (operator 4).

Texts are cut into windows of WINDOW bytes. Bytes are embedded, convolved with filters of several widths, each filter
is maximised over the window, and a softmax layer gives the languages. A text's prediction is the mean of its windows'
log probabilities. The network is trained in numpy (Adam, cross entropy) on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscope.llm.common import cut, map_batches, small

WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
#: The training sample: documents of each language, in the order of a hash of the doc_id; windows of a document, evenly
#: spread over it. All languages are learned, so the driver gets up to 600 KB of windows for each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 6
EPOCHS, BATCH, RATE, SEED = 8, 64, 3e-3, 7
#: Windows that go through the network at once.
AT_ONCE = 256
UNKNOWN = "und"


def windows(text: str) -> np.ndarray:
    """The text's bytes (A-Z lower-cased) in rows of WINDOW, the last one filled with zeros."""
    data = text.encode("utf-8", "surrogatepass").lower()
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def _columns(x: np.ndarray, width: int) -> np.ndarray:
    """(rows, places, EMBED) -> (rows * places, width * EMBED): what each filter place sees."""
    places = x.shape[1] - width + 1
    return np.concatenate([x[:, i:i + places] for i in range(width)], axis=2).reshape(-1, width * x.shape[2])


class ByteCnn:
    """Embedding, filters of each width with bias, softmax layer; float32."""

    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.langs = langs
        self.p = {"embed": draw(256, EMBED, scale=0.5), "out": draw(FILTERS * len(WIDTHS), len(langs), scale=0.1),
                  "out_bias": np.zeros(len(langs), np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = draw(w * EMBED, FILTERS, scale=(w * EMBED) ** -0.5)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def _pooled(self, x: np.ndarray, keep: bool = False):
        """Filters maximised over the window and rectified; with ``keep`` also what the gradient needs."""
        e = self.p["embed"][x]
        pooled, kept = [], []
        for w in WIDTHS:
            seen = _columns(e, w)
            y = (seen @ self.p[f"w{w}"]).reshape(len(x), -1, FILTERS)
            if keep:
                at = y.argmax(axis=1)
                top = np.take_along_axis(y, at[:, None], axis=1)[:, 0]
                kept.append((seen.reshape(len(x), -1, w * EMBED), at))
            else:
                top = y.max(axis=1)
            pooled.append(top + self.p[f"b{w}"])
        h = np.maximum(np.concatenate(pooled, axis=1), 0)
        return (h, kept) if keep else h

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(x), AT_ONCE):
            z = self._pooled(x[at:at + AT_ONCE]) @ self.p["out"] + self.p["out_bias"]
            z = z - z.max(axis=1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, kept = self._pooled(x, keep=True)
        z = h @ self.p["out"] + self.p["out_bias"]
        prob = np.exp(z - z.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(len(y)), y] -= 1
        prob /= len(y)
        g = {"out": h.T @ prob, "out_bias": prob.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
        dh = (prob @ self.p["out"].T) * (h > 0)
        rows = np.arange(len(x))[:, None]
        for i, (w, (seen, at)) in enumerate(zip(WIDTHS, kept)):
            d = dh[:, i * FILTERS:(i + 1) * FILTERS]
            best = seen[rows, at]  # (rows, FILTERS, width * EMBED): what the winning place saw
            g[f"b{w}"] = d.sum(axis=0)
            g[f"w{w}"] = np.einsum("rf,rfk->kf", d, best)
            back = (d[:, :, None] * self.p[f"w{w}"].T[None]).reshape(len(x), FILTERS, w, EMBED)
            np.add.at(g["embed"], x[rows[:, :, None], at[:, :, None] + np.arange(w)], back)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> "ByteCnn":
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                take = order[at:at + BATCH]
                for k, g in self._gradient(x[take], y[take]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9 ** step))
                                  / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of each text; a text that is null or has no letter is of unknown language."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        held, of, count = [], [], 0

        def flush():
            # Windows of several texts go through together; a text's result is the mean over its own.
            lp, at = self.log_probs(np.concatenate(held)), 0
            for i, n in of:
                mean = lp[at:at + n].mean(axis=0, dtype=np.float64)
                p = np.exp(mean - mean.max())
                out[i] = self.langs[int(p.argmax())], float(p.max() / p.sum())
                at += n
            held.clear()
            of.clear()

        for i, text in enumerate(texts):
            if text and self.langs and any(map(str.isalpha, text)):
                held.append(windows(text))
                of.append((i, len(held[-1])))
                count += len(held[-1])
                if count >= AT_ONCE:
                    flush()
                    count = 0
        if held:
            flush()
        return out


def train(docs: DataFrame, learn: Column, max_docs: int = SAMPLE_DOCS, epochs: int = EPOCHS) -> ByteCnn:
    """Train on up to ``max_docs`` documents of each language among rows for which ``learn`` holds, with non-null text,
    lang and doc_id. The sample is the same however the table is split."""
    rows = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    # Rows of one doc_id, however many, are one document: that of the smallest text hash.
    ids = rows.groupBy("doc_id", "lang").agg(F.min("th").alias("th")).withColumn("h", F.xxhash64("doc_id"))
    ids = cut(ids.withColumn("range", F.shiftright("h", 52)), "langid-ids")
    # The first ranges of hashes that hold enough ids of a language, by counts; then the first ids of those few rows.
    counts = ids.groupBy("lang", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    enough = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(
        F.col("before") < max_docs).select("lang", "range")
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = ids.join(enough, ["lang", "range"], "left_semi").withColumn("at", F.row_number().over(order))
    ids = ids.where(F.col("at") <= max_docs).select("doc_id", "lang", "th")
    ids = small(cut(ids, "langid-sample"), 64)
    # At most SAMPLE_WINDOWS windows of a text leave the task that read it, and of a document once.
    found = rows.join(ids, ["doc_id", "lang", "th"]).select("doc_id", "lang", "text").mapInArrow(
        _sample_windows, "doc_id long, lang string, data binary")
    found = found.groupBy("doc_id", "lang").agg(F.min("data").alias("data"))
    sample = sorted((r["lang"], bytes(r["data"])) for r in found.collect())
    langs = sorted({lang for lang, _ in sample})
    model = ByteCnn(langs)
    if not sample:
        return model
    place = {lang: i for i, lang in enumerate(langs)}
    x = np.concatenate([np.frombuffer(d, np.uint8).reshape(-1, WINDOW) for _, d in sample])
    y = np.concatenate([np.full(len(d) // WINDOW, place[lang]) for lang, d in sample])
    return model.fit(x, y, epochs)


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met = set()
    for batch in batches:
        ids, langs = batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist()
        at = [i for i, k in enumerate(zip(ids, langs)) if not (k in met or met.add(k))]
        data = []
        for text in batch.column("text").take(pa.array(at, pa.int64())).to_pylist():
            w = windows(text)
            data.append(w[np.unique(np.linspace(0, len(w) - 1, SAMPLE_WINDOWS).astype(int))].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in at], pa.int64()), pa.array([langs[i] for i in at], pa.string()),
             pa.array(data, pa.binary())], names=["doc_id", "lang", "data"])



_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(model: ByteCnn):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()),
                                              pa.array([s for _, s in found], pa.float64())], schema=_OUT)
    return run


def identify(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """One row per document row: doc_id, lang_pred, score (its probability; 0 for `und`).

    Null texts, and texts without a letter, are `und`; so is everything for a model that learned no language. Only
    doc_id and text are read; null and repeated ids stay as they are. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, _predict(model), "doc_id long, lang_pred string, score double")
