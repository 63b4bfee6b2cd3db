"""Structured Streaming: event ingest (ST-1), the live run fold (ST-2/ST-4/ST-5) and live span building (ST-3).

* Ingest reads JSON-lines event files once, splits valid events from bad lines (dead letters) and writes both as one
  folder a batch, which appears all at once and is never written twice: a batch that is run again after a crash
  changes nothing, downstream either.
* The run fold is the batch fold's aggregate run as a streaming ``update`` aggregation. Each micro-batch's changed
  runs are a folder of their own; every few batches they are folded into a snapshot, so readers open the newest
  snapshot and a bounded number of batches, however long the stream has run.
* Live spans keep the open spans of a run as its state (``applyInPandasWithState``), however long a run pauses; a
  span gets a row when it is left running by the batch that opened it, and one when it closes.
"""

from __future__ import annotations

import heapq
import json
import os
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runscope.operators import runs as R
from runscope.operators.trace import SPAN_SCHEMA, SPAN_SCHEMA_NAMES, SpanReplay, span_row
from runscope.session import SharedFolder
from runscope.sources.files import parse_event_lines

EVENT_LOG_SCHEMA = "seq bigint, run_id string, type string, agent string, timestamp string, data string"


def _trigger(writer, available_now: bool, interval: str):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)


def ingest(spark: SparkSession, source: str, event_log: str, dead_letters: str, checkpoint: str,
           available_now: bool = True, interval: str = "10 seconds", max_files: int | None = None,
           glob: str | None = None) -> list[StreamingQuery]:
    """ST-1 / IO-10 / IO-11: JSON-lines files -> event log (Parquet, a folder a batch) + dead-letter lines.

    The files of the log are sorted by event date, and hold it as a column: the number of files follows the size of the
    events, not the number of days they name, and a filter on the date skips files and row groups by their bounds.

    One query: each batch's lines are read and parsed once, kept while both outputs are written, and published under
    the batch's number. A batch that is run again leaves published outputs as they are and writes those that miss.
    """
    reader = spark.readStream.format("text")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    events, letters = SharedFolder(spark, event_log), SharedFolder(spark, dead_letters)

    def write_batch(lines: DataFrame, batch_id: int) -> None:
        parsed = parse_event_lines(lines).persist()
        try:
            good = (parsed.filter("valid").drop("valid", "raw")
                    .withColumn("event_date", F.to_date(F.col("timestamp").try_cast("timestamp"))))
            bad = parsed.filter(~F.col("valid")).select(F.col("raw").alias("line"))
            events.publish(f"batch_id={batch_id}",
                           lambda path: good.sortWithinPartitions("event_date").write.parquet(path))
            letters.publish(f"batch_id={batch_id}", lambda path: bad.write.parquet(path))
        finally:
            parsed.unpersist()

    w = (reader.load(source).writeStream.option("checkpointLocation", os.path.join(checkpoint, "ingest"))
         .foreachBatch(write_batch))
    return [_trigger(w, available_now, interval).start()]


def read_dead_letters(spark: SparkSession, dead_letters: str) -> DataFrame:
    return spark.read.schema("line string").parquet(dead_letters).select("line")


def read_event_log(spark: SparkSession, event_log: str) -> DataFrame:
    """The appended event log (batch read; filters on event_date skip files and row groups)."""
    return spark.read.schema(EVENT_LOG_SCHEMA + ", event_date date").parquet(event_log)


def event_stream(spark: SparkSession, event_log: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_LOG_SCHEMA + ", event_date date").format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(event_log)


#: Batches of the run fold that are folded into a snapshot at a time.
COMPACT_EVERY = 16


def fold_runs(events: DataFrame, out: str, checkpoint: str, available_now: bool = True,
              interval: str = "10 seconds", compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """ST-2: streaming run fold (update mode). Each micro-batch's changed runs land in ``out/batches/batch_id=N``; every
    ``compact_every`` batches they are folded into a snapshot (``compact_runs``)."""
    agg = R.parse_events(events).groupBy("run_id").agg(*R.fold_aggregates())

    def write_batch(df: DataFrame, batch_id: int) -> None:
        batches = SharedFolder(df.sparkSession, os.path.join(out, "batches"))
        batches.publish(f"batch_id={batch_id}", lambda path: df.write.parquet(path))
        if (batch_id + 1) % compact_every == 0:
            compact_runs(df.sparkSession, out, batch_id)

    w = (agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write_batch))
    return _trigger(w, available_now, interval).start()


def _numbers(folder: SharedFolder) -> list[int]:
    return sorted(int(name.split("=")[1]) for name in folder.names())


def _run_parts(spark: SparkSession, out: str, upto: int | None = None) -> tuple[int, list[str]]:
    """The newest snapshot's number (-1: none), and the folders that make up the run table."""
    snapshots, batches = (SharedFolder(spark, os.path.join(out, x)) for x in ("snapshots", "batches"))
    # Batches are listed first: a snapshot that appears in between holds them, and more.
    later = [n for n in _numbers(batches) if upto is None or n <= upto]
    newest = max([n for n in _numbers(snapshots) if upto is None or n <= upto], default=-1)
    parts = [f"{snapshots.path}/batch_id={newest}"] if newest >= 0 else []
    return newest, parts + [f"{batches.path}/batch_id={n}" for n in later if n > newest]


def _newest_rows(spark: SparkSession, parts: list[str]) -> DataFrame:
    """Each run's row from its newest batch. The folders are read on their own, so that each gives its number."""
    found = None
    for path in parts:
        number = int(path.rsplit("=", 1)[1])
        rows = spark.read.parquet(path).withColumn("batch_id", F.lit(number).cast("bigint"))
        found = rows if found is None else found.unionByName(rows)
    rest = [c for c in found.columns if c != "run_id"]
    return found.groupBy("run_id").agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select("run_id", "r.*")


def compact_runs(spark: SparkSession, out: str, batch_id: int) -> bool:
    """Fold the newest snapshot and the batches up to ``batch_id`` into a snapshot of that number.

    The snapshot appears by one move, which is what switches readers to it; a crash before it changes nothing. What
    the snapshot before last replaced is deleted then, so readers that began with the last one can end.
    """
    snapshots, batches = (SharedFolder(spark, os.path.join(out, x)) for x in ("snapshots", "batches"))
    last, parts = _run_parts(spark, out, batch_id)
    made = bool(parts) and snapshots.publish(
        f"batch_id={batch_id}", lambda path: _newest_rows(spark, parts).drop("batch_id").write.parquet(path))
    if made:
        for n in _numbers(batches):
            if n <= last:
                batches.remove(f"batch_id={n}")
        for n in _numbers(snapshots):
            if n < last:
                snapshots.remove(f"batch_id={n}")
    return made


def read_runs(spark: SparkSession, out: str) -> DataFrame:
    """The current runs table: the newest snapshot and the batches after it, each run's newest row."""
    latest = _newest_rows(spark, _run_parts(spark, out)[1])
    return latest.filter(F.col("first_start").isNotNull()).select(*R.fold_select())


# ---- ST-3: live spans ---------------------------------------------------------------------------------------

#: Events of a run that are sorted at once, and span rows that leave together.
SORT_EVENTS, SPAN_ROWS = 1 << 16, 4096


def _chunk(events: list[tuple]) -> Iterator[tuple]:
    """Sorted events, written to a nameless temporary file and read back one by one."""
    with tempfile.TemporaryFile() as f:
        for e in events:
            pickle.dump(e, f)
        f.seek(0)
        events.clear()
        yield  # written: the caller goes on
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def in_order(batches: Iterator[pd.DataFrame], sort_events: int = SORT_EVENTS) -> Iterator[tuple]:
    """The (seq, type, timestamp, agent, data) events of a run by seq: sorted in chunks, which are merged. A worker
    holds one chunk and the head of each other one."""
    held, chunks = [], []
    for pdf in batches:
        for e in zip(pdf["seq"].tolist(), pdf["type"].tolist(), pdf["timestamp"].tolist(), pdf["agent"].tolist(),
                     pdf["data"].tolist()):
            held.append(e)
            if len(held) >= sort_events:
                held.sort(key=lambda x: x[0])
                chunk = _chunk(held)
                next(chunk)
                chunks.append(chunk)
    held.sort(key=lambda x: x[0])
    return heapq.merge(*chunks, held, key=lambda x: x[0])


#: State of a run: the next span number and its open spans (a JSON list, by number).
LIVE_STATE = "next_id long, open string"


def live_rows(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The span rows of the events of a run in one batch, and its new state."""
    first, kept = state.get if state.exists else (0, "[]")
    replay = SpanReplay(first, json.loads(kept))
    for seq, etype, ts, agent, raw in in_order(batches):
        replay.feed(etype, int(seq), ts, agent, raw)
        if len(replay.done) >= SPAN_ROWS:
            yield _span_frame(key, replay.done)
            replay.done = []
    # Spans that closed, and those that opened in this batch and are running: one row of either kind for a span.
    rest = replay.done + [x for x in replay.open.spans.values() if x["id"] >= first]
    state.update((replay.next_id, json.dumps([x | {"tree": None} for x in replay.open.spans.values()])))
    for at in range(0, len(rest), SPAN_ROWS):
        yield _span_frame(key, rest[at:at + SPAN_ROWS])


#: Types that hold nulls beside exact numbers: the frames of several runs are joined into one.
_FRAME_TYPES = {"int": "Int32", "long": "Int64", "double": "float64", "string": "object"}


def _span_frame(key: tuple, spans: list[dict]) -> pd.DataFrame:
    rows = [span_row(key[0], x, None) for x in spans]
    return pd.DataFrame({name: pd.Series([r[name] for r in rows], dtype=_FRAME_TYPES[kind])
                         for name, kind in (c.split() for c in SPAN_SCHEMA.split(", "))})


def live_spans(events: DataFrame) -> DataFrame:
    """ST-3: a streaming frame of span rows: one when a span is seen running at the end of the batch that opened it,
    one when it closes (pre-order is not known live).

    No event is ever dropped as late, and a run may pause for any time: its state (the next span number, the open
    spans) stays in the state store. The state travels with the events of its run, many runs to an Arrow batch, so a
    run costs no call to the store of its own. The events of a run may stand in any order within a batch, and must
    arrive in the order of seq, batch by batch. Sets the RocksDB state store for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass",
                                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ev = events.select("run_id", "seq", "type", "agent", "timestamp", "data")
    return ev.groupBy("run_id").applyInPandasWithState(
        live_rows, outputStructType=SPAN_SCHEMA, stateStructType=LIVE_STATE, outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout)


def write_live_spans(events: DataFrame, out: str, checkpoint: str, available_now: bool = True,
                     interval: str = "10 seconds") -> StreamingQuery:
    w = (live_spans(events).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return _trigger(w, available_now, interval).start()


def read_live_spans(spark: SparkSession, out: str) -> DataFrame:
    """The spans as they are now: the closed row of a span where there is one, else its running row."""
    rows = spark.read.schema(SPAN_SCHEMA).parquet(out)
    rest = [c for c in SPAN_SCHEMA_NAMES if c not in ("run_id", "span_id")]
    newest = F.max_by(F.struct(*rest), F.col("status").eqNullSafe("running").cast("int") * -1)
    return rows.groupBy("run_id", "span_id").agg(newest.alias("s")).select(
        *[F.col(c) if c in ("run_id", "span_id") else F.col(f"s.{c}") for c in SPAN_SCHEMA_NAMES])
