"""Registered streaming queries: the event bindings are written as JSON-lines files into a fresh folder under
the shared checkpoint folder, streamed through ingest -> fold / live spans with ``availableNow`` (several
micro-batches), and the results read back. Their oracles are the batch results of the same events."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.operators.trace import SPAN_COLS
from runscope.plans import oracle as O
from runscope.plans.queries_runs import RUN_CTES
from runscope.plans.queries_trace import TRACE_CTES
from runscope.plans.registry import register
from runscope.session import scratch_path
from runscope.sources import bindings as B
from runscope.streaming import live as S

# The events arrive in this many parts, one after the other; each part is written, ingested and streamed on.
ARRIVALS = 4


def _arrivals(events: DataFrame) -> list[DataFrame]:
    """The events dealt out over the arrivals by seq within their run, so that every long run spans all of them."""
    last = events.groupBy("run_id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    dealt = events.join(last, "run_id").withColumn("part", F.least(F.lit(ARRIVALS - 1), F.floor(
        (F.col("seq") - F.col("lo")) * ARRIVALS / (F.col("hi") - F.col("lo") + 1))))
    return [dealt.where(F.col("part") == i).drop("lo", "hi", "part") for i in range(ARRIVALS)]


def _write_source(events: DataFrame, path: str) -> None:
    line = F.to_json(F.struct("seq", "run_id", "type", "agent", "timestamp", "data")).alias("value")
    events.select(line).write.mode("append").text(path)


def _ingest(spark: SparkSession, parts: list[DataFrame], base: str, junk: DataFrame | None = None, then=None):
    """Write and ingest each part; ``then`` starts the query that follows an ingest."""
    src, log, dead = (os.path.join(base, x) for x in ("source", "event_log", "dead_letters"))
    for i, part in enumerate(parts):
        _write_source(part, src)
        if junk is not None and i == 0:
            junk.write.mode("append").text(src)
        for q in S.ingest(spark, src, log, dead, os.path.join(base, "ckpt_ingest")):
            q.awaitTermination()
        if then is not None:
            then(log).awaitTermination()
    return log, dead


def _broken_lines(spark, sf_dir) -> DataFrame:
    """Lines that are not events: banner lines of the build tool; text after an object; single quotes; no run id."""
    e = B.telemetry_events(spark, sf_dir).where("seq % 97 = 0")
    whole = F.to_json(F.struct("seq", "run_id", "type"))
    lines = F.array(F.concat(F.lit("Running with build tool, event "), F.col("seq").cast("string")),
                    F.concat(whole, F.lit(" trailing")), F.replace(whole, F.lit('"'), F.lit("'")),
                    F.to_json(F.struct("seq", "type")))
    return e.select(F.explode(lines).alias("value"))


@register("runs_stream", O.with_ctes(RUN_CTES, "SELECT * FROM runs"), "ST-1 ST-2 IO-10 IO-11")
def q_runs_stream(spark, sf_dir):
    base = scratch_path(spark, "runs-stream")
    out = os.path.join(base, "runs")
    _ingest(spark, _arrivals(B.telemetry_events(spark, sf_dir)), base, _broken_lines(spark, sf_dir),
            lambda log: S.fold_runs(S.event_stream(spark, log), out, os.path.join(base, "ckpt_fold")))
    return S.read_runs(spark, out)


@register("ingest_dead_letters", """
SELECT 4 * COUNT(*) AS n_dead_letters FROM events WHERE event_id % 97 = 0""", "IO-11 ST-1")
def q_ingest_dead_letters(spark, sf_dir):
    base = scratch_path(spark, "ingest")
    _, dead = _ingest(spark, [B.telemetry_events(spark, sf_dir)], base, _broken_lines(spark, sf_dir))
    return S.read_dead_letters(spark, dead).agg(F.count(F.lit(1)).alias("n_dead_letters"))


LIVE_COLS = [c for c in SPAN_COLS if c != "preorder"]


@register("live_spans_stream", O.with_ctes(TRACE_CTES, f"SELECT {', '.join(LIVE_COLS)} FROM spans"), "ST-3")
def q_live_spans_stream(spark, sf_dir):
    base = scratch_path(spark, "live-spans")
    out = os.path.join(base, "spans")
    _ingest(spark, _arrivals(B.trace_events(spark, sf_dir)), base, then=lambda log: S.write_live_spans(
        S.event_stream(spark, log), out, os.path.join(base, "ckpt_spans")))
    return S.read_live_spans(spark, out).select(*LIVE_COLS)
