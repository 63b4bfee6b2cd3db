"""Run fold semantics, cost estimate, tool-call pairing, search and top-k."""

from pyspark.sql import functions as F

from runscope.functions.columns import estimated_cost_usd, truncate_payload
from runscope.operators import runs as R
from tests.events_util import ev, frame


def _metrics(i, o, cost=None):
    m = {"input_tokens": i, "output_tokens": o}
    if cost is not None:
        m["estimated_cost_usd"] = cost
    return m


def test_fold_semantics(spark):
    rows = [
        ev(0, "run_end", run="a", success=True),                     # before run_start: ignored
        ev(1, "invocation_end", run="a", metrics=_metrics(5, 5)),    # before run_start: ignored
        ev(2, "run_start", run="a", agent_type="ticket"),
        ev(3, "invocation_end", run="a", metrics=_metrics(100, 10, 0.5)),
        ev(4, "invocation_end", run="a", metrics={}),                # empty metrics: no update
        ev(5, "invocation_end", run="a", metrics=_metrics(200, 20)),
        ev(6, "run_start", run="a", agent_type="code-fix"),          # overwrites agent_type / started_at only
        ev(7, "run_end", run="a", success=False, duration_s=3.5),
        ev(8, "run_end", run="b", success=True),                     # no run_start: run b absent
        ev(9, "run_start", run="c"),                                 # still running, agent from envelope
    ]
    runs = {r.run_id: r for r in R.runs_table(frame(spark, rows)).collect()}
    assert set(runs) == {"a", "c"}
    a = runs["a"]
    assert a.agent_type == "code-fix" and a.started_at.startswith("2024-05-01T10:00:06")
    assert (a.success, a.total_duration_s, a.status) == (0, 3.5, "error")
    assert (a.total_input_tokens, a.total_output_tokens, a.estimated_cost_usd) == (200, 20, None)
    c = runs["c"]
    assert c.agent_type == "ticket" and c.status == "running" and c.total_input_tokens == 0
    summed = {r.run_id: r for r in R.runs_table(frame(spark, rows), token_mode="sum").collect()}
    assert summed["a"].total_input_tokens == 300 and summed["a"].estimated_cost_usd == 0.5


def test_cost_example(spark):
    r = spark.range(1).select(estimated_cost_usd(F.lit(1000), F.lit(500), F.lit(2000), F.lit(100)).alias("c")).first()
    assert r.c == 0.011475


def test_truncate_payload(spark):
    df = spark.createDataFrame([("x" * 2005,), ("short",)], "s string")
    out = [r.t for r in df.select(truncate_payload("s").alias("t")).collect()]
    assert out[0] == "x" * 2000 + "... (5 chars truncated)" and out[1] == "short"


def test_tool_calls_pairing(spark):
    rows = [ev(0, "run_start"),
            ev(1, "tool_start", tool_use_id="t1", tool_name="a"),
            ev(2, "tool_start", tool_use_id="t1", tool_name="a"),    # overwrites the start time
            ev(5, "tool_end", tool_use_id="t1", tool_name="a", status="success"),
            ev(6, "tool_end", tool_use_id="t1", tool_name="a", status="success")]  # nothing left to pair
    got = sorted((r.end_seq, r.start_seq, r.duration_s) for r in R.tool_calls(frame(spark, rows)).collect())
    assert got == [(5, 2, 3.0), (6, None, None)]


def test_search_and_recent(spark):
    rows = [ev(i, "run_start", run=f"run-{i}", agent_type="ticket" if i % 2 else "Code-Fix") for i in range(60)]
    rows += [ev(100 + i, "run_end", run=f"run-{i}", success=i % 3 == 0) for i in range(0, 60, 2)]
    runs = R.runs_table(frame(spark, rows))
    recent = R.recent_runs(runs, 50).collect()
    assert len(recent) == 50 and recent[0].run_id == "run-59"
    hits = R.search_runs(runs, query="code", status="success").collect()
    assert {r.run_id for r in hits} == {f"run-{i}" for i in range(0, 60, 6)}
    assert R.search_runs(runs, status="running").count() == 30


def test_reset_mode_starts_a_fresh_record(spark):
    rows = [ev(0, "run_start", run="a", agent_type="ticket"),
            ev(1, "invocation_end", run="a", metrics=_metrics(100, 10, 0.5)),
            ev(2, "run_end", run="a", success=True, duration_s=2.0),
            ev(3, "run_start", run="a", agent_type="code-fix"),
            ev(4, "invocation_end", run="a", metrics=_metrics(0, 7))]   # zero input tokens: ignored live
    db = R.runs_table(frame(spark, rows)).first()
    live = R.runs_table(frame(spark, rows), token_mode="reset").first()
    assert (db.status, db.total_duration_s, db.total_input_tokens) == ("success", 2.0, 0)
    assert (live.status, live.ended_at, live.total_input_tokens, live.estimated_cost_usd) == ("running", None, 0, None)
    assert live.agent_type == "code-fix"
