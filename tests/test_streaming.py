"""Streaming ingest, fold and live spans against their batch counterparts, across micro-batches."""

import json
import os
import random

import pandas as pd
import pytest

from runscope.operators import runs as R
from runscope.operators import trace as TR
from runscope.streaming import live as S
from tests.events_util import EVENT_DDL, frame, random_well_nested

LIVE_COLS = [c for c in TR.SPAN_COLS if c != "preorder"]


def _write_lines(path, name, rows, extra=()):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        for r in rows:
            seq, run, etype, agent, ts, data = r
            f.write(json.dumps({"seq": seq, "run_id": run, "type": etype, "agent": agent, "timestamp": ts,
                                "data": data}) + "\n")
        for line in extra:
            f.write(line + "\n")


def test_ingest_fold_and_spans_match_batch(spark, tmpdir_path):
    rng = random.Random(3)
    rows = []
    for i in range(12):
        rows += random_well_nested(rng, f"run{i}", rng.randint(5, 40), seq0=i * 1000)
    rows.sort(key=lambda r: r[0])
    half = len(rows) // 2
    src = os.path.join(tmpdir_path, "src")
    log, dead = os.path.join(tmpdir_path, "log"), os.path.join(tmpdir_path, "dead")
    out_runs, out_spans = os.path.join(tmpdir_path, "runs"), os.path.join(tmpdir_path, "spans")
    ck = os.path.join(tmpdir_path, "ck")

    # two arrivals: runs are split across micro-batches, so fold and span state must carry over
    for part, chunk, junk in [(0, rows[:half], ["not json", '{"type": 1']), (1, rows[half:], [])]:
        _write_lines(src, f"part{part}.jsonl", chunk, junk)
        for q in S.ingest(spark, src, log, dead, os.path.join(ck, "ingest")):
            q.awaitTermination()
        S.fold_runs(S.event_stream(spark, log), out_runs, os.path.join(ck, "fold")).awaitTermination()
        S.write_live_spans(S.event_stream(spark, log), out_spans, os.path.join(ck, "spans")).awaitTermination()

    assert S.read_dead_letters(spark, dead).count() == 2
    logged = S.read_event_log(spark, log)
    assert logged.count() == len(rows)

    batch_runs = sorted(tuple(r) for r in R.runs_table(frame(spark, rows)).collect())
    stream_runs = sorted(tuple(r) for r in S.read_runs(spark, out_runs).collect())
    assert batch_runs == stream_runs and len(stream_runs) == 12

    batch_spans = sorted(tuple(r) for r in TR.trace_spans(frame(spark, rows)).select(*LIVE_COLS).collect())
    live = sorted(tuple(r) for r in S.read_live_spans(spark, out_spans).select(*LIVE_COLS).collect())
    assert batch_spans == live


def test_event_schema_is_declared(spark):
    assert frame(spark, []).schema.simpleString().startswith("struct<seq:bigint")
    assert EVENT_DDL.split(",")[0] == "seq long"


def test_live_spans_any_batches_and_pauses(spark, tmpdir_path):
    """Runs that pause for days, cut into any number of arrivals, some never closed: the rows of the batch replay."""
    rng = random.Random(8)
    rows = []
    for i in range(4):
        run = random_well_nested(rng, f"run{i}", 30, seq0=i * 1000)
        rows += [(q, r, t, a, f"2024-0{1 + k % 9}-{1 + k % 27:02d}T00:00:00+00:00", d)
                 for k, (q, r, t, a, _, d) in enumerate(run[:-i or None])]
    rows.sort(key=lambda r: r[0] % 1000)
    expected = sorted((tuple(r) for r in TR.trace_spans(frame(spark, rows)).select(
        "run_id", "span_id", "parent_id", "status", "end_seq").collect()), key=str)
    for parts in (1, 3, 6):
        base = os.path.join(tmpdir_path, f"parts{parts}")
        for i in range(parts):
            part = rows[i * len(rows) // parts:(i + 1) * len(rows) // parts]
            _write_lines(os.path.join(base, "src"), f"part{i}.jsonl", part)
            for q in S.ingest(spark, os.path.join(base, "src"), os.path.join(base, "log"), os.path.join(base, "dead"),
                              os.path.join(base, "ck")):
                q.awaitTermination()
            S.write_live_spans(S.event_stream(spark, os.path.join(base, "log")), os.path.join(base, "spans"),
                               os.path.join(base, "ck_spans")).awaitTermination()
        got = S.read_live_spans(spark, os.path.join(base, "spans")).select(
            "run_id", "span_id", "parent_id", "status", "end_seq").collect()
        assert sorted((tuple(r) for r in got), key=str) == expected


def test_ingest_survives_a_crash_between_its_outputs(spark, tmpdir_path, monkeypatch):
    """Killed after the events and before the dead letters, and again after both: nothing is lost or doubled."""
    from runscope.session import SharedFolder

    src, log, dead, ck = (os.path.join(tmpdir_path, x) for x in ("src", "log", "dead", "ck"))
    rows = random_well_nested(random.Random(1), "run", 30)
    _write_lines(src, "a.jsonl", rows, ["not json"])
    publish = SharedFolder.publish

    def killed(self, name, write):
        if self.path == dead:
            raise RuntimeError("killed")
        return publish(self, name, write)
    monkeypatch.setattr(SharedFolder, "publish", killed)
    with pytest.raises(Exception):
        S.ingest(spark, src, log, dead, ck)[0].awaitTermination()
    monkeypatch.setattr(SharedFolder, "publish", publish)
    assert S.read_event_log(spark, log).count() == len(rows) and not os.path.exists(dead)
    files = sorted(S.read_event_log(spark, log).inputFiles())
    S.ingest(spark, src, log, dead, ck)[0].awaitTermination()
    # As if the batch had not been noted as done: it runs once more.
    os.remove(os.path.join(ck, "ingest", "commits", "0"))
    for extra in os.listdir(os.path.join(ck, "ingest", "commits")):
        os.remove(os.path.join(ck, "ingest", "commits", extra))
    S.ingest(spark, src, log, dead, ck)[0].awaitTermination()
    assert sorted(S.read_event_log(spark, log).inputFiles()) == files
    assert S.read_event_log(spark, log).count() == len(rows) and S.read_dead_letters(spark, dead).count() == 1


def test_run_table_stays_small(spark, tmpdir_path, monkeypatch):
    """Forty micro-batches: readers open a snapshot and few batches; a crash before the switch, or a batch that comes
    twice, changes nothing."""
    from runscope.session import SharedFolder

    rng, src, log, dead, ck, out = random.Random(6), *(os.path.join(tmpdir_path, x) for x in
                                                       ("src", "log", "dead", "ck", "out"))
    rows = [r for i in range(20) for r in random_well_nested(rng, f"run{i}", 20, seq0=i * 1000)]
    rows.sort(key=lambda r: r[0] % 1000)
    for i in range(40):
        _write_lines(src, f"p{i:02d}.jsonl", rows[i * len(rows) // 40:(i + 1) * len(rows) // 40])
    S.ingest(spark, src, log, dead, ck, max_files=1)[0].awaitTermination()
    stream = S.event_stream(spark, log, max_files=1)
    S.fold_runs(stream, out, os.path.join(ck, "fold"), compact_every=4).awaitTermination()
    expected = sorted(tuple(r) for r in R.runs_table(frame(spark, rows)).collect())
    read = lambda: sorted(tuple(r) for r in S.read_runs(spark, out).collect())
    assert read() == expected
    newest, parts = S._run_parts(spark, out)
    assert newest >= 35 and len(parts) <= 4
    assert len(os.listdir(os.path.join(out, "batches"))) < 20

    last = max(S._numbers(SharedFolder(spark, os.path.join(out, "batches"))))
    again = SharedFolder(spark, os.path.join(out, "batches")).publish(f"batch_id={last}", lambda p: 1 / 0)
    assert again is False and read() == expected
    if last > newest:
        move = SharedFolder.move

        def killed(self, old, new):
            raise RuntimeError("killed")
        monkeypatch.setattr(SharedFolder, "move", killed)
        with pytest.raises(RuntimeError):
            S.compact_runs(spark, out, last)
        monkeypatch.setattr(SharedFolder, "move", move)
        assert S._run_parts(spark, out)[0] == newest and read() == expected
        assert S.compact_runs(spark, out, last)
    assert read() == expected and not S.compact_runs(spark, out, last)


def test_events_in_order_hold_one_chunk():
    """A run of 300,000 events of one batch in any order: sorted, with few of them in memory."""
    import tracemalloc

    n = 300_000

    def frames():
        for at in range(0, n, 5000):
            seqs = [(s * 7919) % n for s in range(at, at + 5000)]
            yield pd.DataFrame({"seq": seqs, "type": "token", "timestamp": "t", "agent": "a",
                                "data": [f"payload of event {s} " * 5 for s in seqs]})
    tracemalloc.start()
    last = -1
    for e in S.in_order(frames(), sort_events=10_000):
        assert e[0] == last + 1
        last = e[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert last == n - 1 and peak < 16 << 20


def test_live_spans_of_shuffled_batches(spark, tmpdir_path):
    """Events of a batch may stand in any order."""
    rng = random.Random(12)
    rows = random_well_nested(rng, "big", 2500)
    expected = sorted((tuple(r) for r in TR.trace_spans(frame(spark, rows)).select(*LIVE_COLS).collect()), key=str)
    src, log, dead, ck, out = (os.path.join(tmpdir_path, x) for x in ("src", "log", "dead", "ck", "out"))
    for i in range(2):
        part = rows[i * len(rows) // 2:(i + 1) * len(rows) // 2]
        rng.shuffle(part)
        _write_lines(src, f"p{i}.jsonl", part)
        S.ingest(spark, src, log, dead, ck)[0].awaitTermination()
        S.write_live_spans(S.event_stream(spark, log), out, os.path.join(ck, "spans")).awaitTermination()
    assert sorted((tuple(r) for r in S.read_live_spans(spark, out).select(*LIVE_COLS).collect()), key=str) == expected


def test_event_log_files_do_not_follow_days(spark, tmpdir_path):
    """Events of 300 days: a few files, still sorted and filtered by date."""
    src, log, dead, ck = (os.path.join(tmpdir_path, x) for x in ("src", "log", "dead", "ck"))
    rows = [(i, f"r{i % 7}", "run_start", "a", str(pd.Timestamp("2023-01-01") + pd.Timedelta(days=i)), "{}")
            for i in range(300)]
    _write_lines(src, "a.jsonl", rows)
    S.ingest(spark, src, log, dead, ck)[0].awaitTermination()
    files = [f for _, _, names in os.walk(log) for f in names if f.endswith(".parquet")]
    assert len(files) <= 8
    logged = S.read_event_log(spark, log)
    assert logged.count() == 300
    assert [r["seq"] for r in logged.where("event_date = '2023-02-01'").collect()] == [31]


def test_live_spans_keep_large_numbers(spark, tmpdir_path):
    """Sequence numbers above 2^53 are exact, beside spans that are still running."""
    src, log, dead, ck, out = (os.path.join(tmpdir_path, x) for x in ("src", "log", "dead", "ck", "out"))
    big = (1 << 60) + 1
    rows = [(big, "r", "run_start", "a", None, "{}"), (big + 2, "r", "model_call_start", "a", None, "{}"),
            (big + 4, "r", "model_call_end", "a", None, "{}")]
    _write_lines(src, "a.jsonl", rows)
    S.ingest(spark, src, log, dead, ck)[0].awaitTermination()
    S.write_live_spans(S.event_stream(spark, log), out, os.path.join(ck, "spans")).awaitTermination()
    got = S.read_live_spans(spark, out).select("span_type", "start_seq", "end_seq").collect()
    assert sorted(tuple(r) for r in got) == [("llm", big + 2, big + 4), ("run", big, None)]
