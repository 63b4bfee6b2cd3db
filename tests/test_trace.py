"""Span building: adversarial sequences for the exact replay, and replay == Catalyst-only on well-nested runs."""

import random

import pytest

from runscope.operators import trace as TR
from tests.events_util import ev, frame, random_well_nested

COLS = [c for c in TR.SPAN_COLS]


def _spans(spark, rows):
    return {r.span_id: r for r in TR.trace_spans(frame(spark, rows)).collect()}


def test_nested_run(spark):
    rows = [ev(0, "run_start", agent_type="ticket"), ev(1, "invocation_start", agent_name="ticket"),
            ev(2, "model_call_start"), ev(3, "token", text="Hel"), ev(4, "token", text="lo"),
            ev(5, "model_call_end", stop_reason="tool_use"),
            ev(6, "tool_start", tool_name="read_logs", tool_use_id="t1"),
            ev(8, "tool_end", tool_name="read_logs", tool_use_id="t1", status="success", duration_s=1.5),
            ev(9, "invocation_end", agent_name="ticket"), ev(10, "run_end", success=True, duration_s=10.0)]
    s = _spans(spark, rows)
    assert [s[k].name for k in sorted(s)] == ["Run: ticket", "Invocation: ticket", "LLM Call (tool_use)",
                                             "Tool: read_logs"]
    assert s["n2"].token_text == "Hello" and s["n2"].parent_id == "n1" and s["n2"].depth == 2
    assert s["n3"].duration_s == 1.5 and s["n2"].duration_s == 3.0 and s["n0"].duration_s == 10.0
    assert s["n1"].duration_s == 8.0 and all(x.status == "success" for x in s.values())


def test_adversarial_sequences(spark):
    rows = [
        ev(0, "tool_end", tool_use_id="zz"),                 # unmatched end: ignored
        ev(1, "run_start", agent_type="ticket"),
        ev(2, "invocation_start"),
        ev(3, "reasoning", text="thinking"),                 # no open llm: only a block
        ev(4, "tool_start", tool_name="a", tool_use_id=""),  # empty id
        ev(5, "model_call_start"),
        ev(6, "tool_end", tool_use_id="", status="error"),   # empty id -> nearest tool, from the middle
        ev(7, "token", text="x"),                            # llm still open
        ev(8, "run_start", agent_type="code-fix"),           # second run_start: a new root
        ev(9, "metrics"),                                    # attached to the top, never open
        ev(10, "model_call_end", error="boom"),
        ev(11, "run_end", success=False),                    # closes the nearest run (the second one)
    ]
    s = _spans(spark, rows)
    assert s["n0"].name == "Run: ticket" and s["n0"].status == "running" and s["n0"].end_seq is None
    assert s["n1"].status == "running"                       # invocation never ended
    tool = s["n2"]
    assert tool.status == "error" and tool.end_seq == 6 and tool.parent_id == "n1"
    llm = s["n3"]
    assert llm.parent_id == "n2" and llm.token_text == "x" and llm.status == "error" and llm.name == "LLM Call"
    second = s["n4"]
    assert second.parent_id is None and second.depth == 0 and second.status == "error" and second.end_seq == 11
    assert s["n5"].span_type == "metrics" and s["n5"].parent_id == "n4" and s["n5"].status is None
    blocks = TR.reasoning_blocks(frame(spark, rows)).collect()
    assert [(b.block_id, b.invocation_idx, b.text) for b in blocks] == [("rb_0", 1, "thinking")]


def test_tool_id_match_beats_type(spark):
    rows = [ev(0, "run_start"), ev(1, "sub_agent_start", sub_agent_name="ticket_agent", tool_use_id="s1"),
            ev(2, "tool_start", tool_name="inner", tool_use_id="t9"),
            ev(3, "tool_end", tool_use_id="s1", status="success"),   # closes the agent (id match, any type)
            ev(4, "sub_agent_end", tool_use_id="nope"),              # falls back to type: no agent left
            ev(5, "tool_end", tool_use_id="t9")]
    s = _spans(spark, rows)
    assert s["n1"].span_type == "agent" and s["n1"].end_seq == 3
    assert s["n2"].end_seq == 5


def test_permutation_invariance(spark):
    rng = random.Random(7)
    rows = random_well_nested(rng, "p", 60)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    a = sorted((tuple(r) for r in TR.trace_spans(frame(spark, rows)).select(*COLS).collect()), key=repr)
    b = sorted((tuple(r) for r in TR.trace_spans(frame(spark, shuffled)).select(*COLS).collect()), key=repr)
    assert a == b


def test_native_equals_replay_on_well_nested(spark):
    rng = random.Random(11)
    rows = []
    for i in range(25):
        rows += random_well_nested(rng, f"run{i}", rng.randint(5, 80), seq0=i * 10_000)
    df = frame(spark, rows)
    a = sorted((tuple(r) for r in TR.trace_spans(df).select(*COLS).collect()), key=repr)
    b = sorted((tuple(r) for r in TR.trace_spans_native(df).select(*COLS).collect()), key=repr)
    assert len(a) > 100 and a == b


def test_hybrid_equals_replay_on_mixed_runs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(10):
        rows += random_well_nested(rng, f"ok{i}", rng.randint(5, 50), seq0=i * 10_000)
    # disturbed runs: unmatched end, close from the middle, nested run_start, id mismatch
    rows += [ev(200_000, "tool_end", run="bad1"), ev(200_001, "run_start", run="bad1"), ev(200_002, "run_end", run="bad1")]
    rows += [ev(210_000, "run_start", run="bad2"), ev(210_001, "invocation_start", run="bad2"),
             ev(210_002, "model_call_start", run="bad2"), ev(210_003, "invocation_end", run="bad2"),
             ev(210_004, "token", run="bad2", text="t"), ev(210_005, "model_call_end", run="bad2")]
    rows += [ev(220_000, "run_start", run="bad3"), ev(220_001, "invocation_start", run="bad3"),
             ev(220_002, "run_start", run="bad3", agent_type="inner"), ev(220_003, "run_end", run="bad3", success=True)]
    rows += [ev(230_000, "run_start", run="bad4"), ev(230_001, "tool_start", run="bad4", tool_use_id="a"),
             ev(230_002, "tool_start", run="bad4", tool_use_id="b"), ev(230_003, "tool_end", run="bad4", tool_use_id="a"),
             ev(230_004, "tool_end", run="bad4", tool_use_id="b")]
    df = frame(spark, rows)
    a = sorted((tuple(r) for r in TR.trace_spans(df).select(*COLS).collect()), key=repr)
    b = sorted((tuple(r) for r in TR.trace_spans_hybrid(df).select(*COLS).collect()), key=repr)
    assert a == b


def test_hybrid_equals_replay_on_telemetry_binding(spark):
    from runscope.sources import bindings as B
    from tests.conftest import SF_SMALL
    ev_df = B.telemetry_events(spark, SF_SMALL)
    a = sorted((tuple(r) for r in TR.trace_spans(ev_df).select(*COLS).collect()), key=repr)
    b = sorted((tuple(r) for r in TR.trace_spans_hybrid(ev_df).select(*COLS).collect()), key=repr)
    assert len(a) > 50 and a == b


@pytest.mark.parametrize("good,bad,nameless", [(2, 0, False), (0, 2, False), (2, 0, True), (0, 0, True), (1, 1, True),
                                               (0, 0, False)])
def test_hybrid_leaves_out_the_path_no_run_takes(spark, good, bad, nameless):
    rng = random.Random(3)
    rows = []
    for i in range(good):
        rows += random_well_nested(rng, f"ok{i}", 20, seq0=i * 10_000)
    for i in range(bad):
        rows += [ev(100_000 + i, "tool_end", run=f"bad{i}"), ev(110_000 + i, "run_start", run=f"bad{i}")]
    if nameless:
        rows += [ev(200_000, "run_start", run=None), ev(200_001, "run_end", run=None, success=True)]
    df = frame(spark, rows)
    a = sorted((tuple(r) for r in TR.trace_spans(df).select(*COLS).collect()), key=repr)
    b = sorted((tuple(r) for r in TR.trace_spans_hybrid(df).select(*COLS).collect()), key=repr)
    assert a == b and bool(a) == bool(rows)


def disturbed(rng, run, n):
    kinds = ["run_start", "invocation_start", "model_call_start", "tool_start", "sub_agent_start", "metrics", "run_end",
             "invocation_end", "model_call_end", "tool_end", "sub_agent_end", "token", "tool_end", "model_call_end"]
    return [ev(i, rng.choice(kinds), run=run, tool_use_id=rng.choice(["a", "b", "c", None]), text="x")
            for i in range(n)]


def test_preorder_of_disturbed_runs(spark):
    rng = random.Random(9)
    rows = [r for i in range(12) for r in disturbed(rng, f"d{i}", rng.randint(1, 120))]
    rows += [(s, None, *rest) for s, _, *rest in disturbed(rng, "none", 80)]
    runs = {}
    for r in TR.trace_spans(frame(spark, rows)).collect():
        runs.setdefault(r.run_id, []).append(r)
    assert len(runs) == 13
    moved = 0
    for spans in runs.values():
        path = {}
        for r in sorted(spans, key=lambda x: int(x.span_id[1:])):
            path[r.span_id] = path.get(r.parent_id, ()) + (int(r.span_id[1:]),)
        expected = {s: i for i, s in enumerate(sorted(path, key=path.get))}
        assert {r.span_id: r.preorder for r in spans} == expected
        moved += sum(i != int(s[1:]) for s, i in expected.items())
    assert moved > 0


def test_replay_holds_open_spans_only():
    """A long run goes through batch by batch: spans that closed leave before the next batch is read."""
    import pyarrow as pa

    names, read = ["seq", "run_id", "type", "agent", "timestamp", "data"], []
    schema = pa.schema([(c, pa.int64() if c in ("seq", "_part", "idx", "innermost") else pa.bool_()
                         if c == "never_closed" else pa.struct([]) if c == "start" else pa.string())
                        for c in TR._PART_COLUMNS])

    def batches():
        for b in range(20):
            read.append(b)
            rows = [ev(b * 100 + i, ("tool_start", "tool_end")[i % 2], tool_use_id="t") for i in range(100)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) | {"_run": "=r1", "_part": TR.WHOLE} for r in rows],
                                             schema=schema)
    out = [(len(read), batch.num_rows) for batch in TR.replay_parts(batches())]
    assert out == [(b + 1, 50) for b in range(20)]


def calls(rng, run, n, ids):
    """Calls of tools and agents with ends that are missing, doubled or in the wrong place, and run spans in between."""
    out = []
    for i in range(n):
        etype = rng.choice(["run_start", "run_end", "tool_start", "tool_end", "tool_end", "sub_agent_start",
                            "sub_agent_end", "sub_agent_end", "model_call_start", "model_call_end", "model_call_end",
                            "invocation_end", "token", "metrics", "reasoning"])
        data = {"text": f"t{i}", "agent_type": f"a{i}", "success": i % 3 > 0}
        if etype.startswith(("tool", "sub")):
            data["tool_use_id"] = rng.choice(ids(etype))
        out.append(ev(i, etype, run=run, **data))
    return out


@pytest.mark.parametrize("shared_ids", [False, True])
def test_cut_runs_equal_whole_runs(spark, monkeypatch, shared_ids):
    """Runs cut into parts give what their whole replay gives, also where run spans stay open over many parts, and
    where tool ids may close spans of other types (those are replayed whole)."""
    monkeypatch.setattr(TR, "SEQ_CHUNK", 16)
    rng = random.Random(21)
    ids = lambda e: ["x", "y", "", None, 7] if shared_ids else ["a" + e[:3], "b" + e[:3], "", None]
    rows = [r for i in range(6) for r in calls(rng, f"c{i}", rng.randint(1, 400), ids)]
    rows += [(s, None, *rest) for s, _, *rest in calls(rng, "none", 150, ids)]
    rows += random_well_nested(rng, "nested", 300)
    df = frame(spark, rows)
    cols = TR.SPAN_SCHEMA_NAMES
    whole = sorted((tuple(r) for r in TR.trace_spans(df, run_events=1 << 30).select(*cols).collect()), key=repr)
    parts = sorted((tuple(r) for r in TR.trace_spans(df, run_events=20).select(*cols).collect()), key=repr)
    assert len(whole) > 300 and parts == whole


def test_a_long_run_is_several_tasks(spark, monkeypatch):
    """One run with a third of all events is replayed by several tasks."""
    monkeypatch.setattr(TR, "SEQ_CHUNK", 64)
    rng = random.Random(3)
    rows = [(s, "hot", *rest) for s, _, *rest in calls(rng, "hot", 2000, lambda e: [e[:3], ""])]
    parts = TR._cut_runs(TR._keyed(frame(spark, rows))).groupBy("_part").count().collect()
    assert len(parts) >= 10 and max(r["count"] for r in parts) < 600
