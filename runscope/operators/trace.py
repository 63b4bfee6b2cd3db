"""Part D (trace analytics): events of a run -> span tree rows, reasoning blocks, LLM text, timeline rows.

Two span builders:

* ``trace_spans`` (TR-1) replays the exact stack semantics (close-by-type from the middle of the stack,
  tool-id matching, unmatched ends ignored, run_start always a root). Events are sorted by (run, seq) inside
  partitions (a sort that spills) and read batch by batch, so a worker holds one batch and the open spans of one
  run. Long runs are cut where nothing but run spans is open; the places are found by floor-clamped running sums of
  the open spans of each type, and the parts are replayed by tasks of their own. Pre-order positions are added
  afterwards, from the sizes of the trees and their parts.
* ``trace_spans_native`` (TR-2) computes the same rows for well-nested runs with Catalyst only: depth is a
  running sum of +1/-1, the k-th open at a depth pairs with the k-th close at that depth (an equi-join), and
  a parent is the last open one level up (one ``last(..., ignorenulls)`` column per level, all in one window).
  The running sums are the two-level, skew-safe ``running_sums``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscope.functions.columns import millis_between
from runscope.operators.sequences import running_last, running_sums
from runscope.session import cut

SPAN_COLS = ["run_id", "span_id", "parent_id", "depth", "preorder", "span_type", "name", "start_seq", "end_seq",
             "start_time", "end_time", "duration_s", "status", "tool_use_id", "token_text", "reasoning_text"]
SPAN_SCHEMA = ("run_id string, span_id string, parent_id string, depth int, preorder int, span_type string, "
               "name string, start_seq long, end_seq long, start_time string, end_time string, duration_s double, "
               "status string, tool_use_id string, token_text string, reasoning_text string, data string")

OPEN_TYPE = {"run_start": "run", "invocation_start": "invocation", "model_call_start": "llm",
             "tool_start": "tool", "sub_agent_start": "agent"}
CLOSE_TYPE = {"run_end": "run", "invocation_end": "invocation", "model_call_end": "llm", "tool_end": "tool",
              "sub_agent_end": "agent"}
# Span types whose end payload may carry its own duration.
PAYLOAD_DURATION = {"run", "tool", "agent"}
# Width in seq of a chunk of the running sums: a longer run is split into several.
SEQ_CHUNK = 1 << 16


# ---- TR-1: exact stack replay --------------------------------------------------------------------------------

def _ms(ts: str | None):
    """Epoch milliseconds of an ISO timestamp (naive = UTC); None when missing or unparsable."""
    if not ts:
        return None
    try:
        t = pd.Timestamp(ts)
    except (ValueError, TypeError):
        return None
    if t is pd.NaT:
        return None
    if t.tzinfo is None:
        t = t.tz_localize("UTC")
    return t.value // 1_000_000


def _number(value) -> float | None:
    """A payload number; None for what is no number (text such as '1.5s' included)."""
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def _payload(raw) -> dict:
    try:
        data = json.loads(raw) if isinstance(raw, str) and raw else {}
    except ValueError:
        return {}
    return data if isinstance(data, dict) else {}


def _given(value, otherwise):
    return otherwise if value is None else value


# What an event opens: span type, and the name from its payload and agent.
_OPENS = {
    "run_start": ("run", lambda d, agent: f"Run: {_given(d.get('agent_type'), agent)}"),
    "invocation_start": ("invocation", lambda d, agent: f"Invocation: {_given(d.get('agent_name'), agent)}"),
    "model_call_start": ("llm", lambda d, agent: "LLM Call"),
    "tool_start": ("tool", lambda d, agent: f"Tool: {_given(d.get('tool_name'), 'unknown')}"),
    "sub_agent_start": ("agent", lambda d, agent: f"Agent: {_given(d.get('sub_agent_name'), 'unknown')}"),
    "metrics": ("metrics", lambda d, agent: "Final Metrics"),
}
# When a closing payload means failure, by span type.
_FAILED = {
    "run": lambda d: not d.get("success"),
    "invocation": lambda d: False,
    "llm": lambda d: bool(d.get("error")),
    "tool": lambda d: d.get("status") == "error",
    "agent": lambda d: d.get("status") == "error",
}
# Which text of a span an event adds to.
_TEXT = {"token": "tokens", "reasoning": "reasoning"}


class OpenSpans:
    """The open spans of one run, found by type or by tool id.

    Span numbers ascend, so the innermost open span is always the one with the highest number: of all, of a type, or
    of a tool id. Each of these is an ascending list, a look-up is its last element.
    """

    def __init__(self, spans: list[dict] = ()):
        self.lists: dict[tuple, list[int]] = {}
        self.spans: dict[int, dict] = {}
        for span in spans:
            self.add(span)

    @staticmethod
    def _keys(span: dict) -> list[tuple]:
        return [("any",), ("type", span["kind"])] + ([("tool", span["tool_use_id"])] if span["tool_use_id"] else [])

    def add(self, span: dict) -> None:
        self.spans[span["id"]] = span
        for k in self._keys(span):
            self.lists.setdefault(k, []).append(span["id"])

    def innermost(self, *key) -> dict | None:
        ids = self.lists.get(key)
        return self.spans[ids[-1]] if ids else None

    def remove(self, span: dict) -> None:
        del self.spans[span["id"]]
        for k in self._keys(span):
            ids = self.lists[k]
            ids.remove(span["id"])
            if not ids:
                del self.lists[k]


class SpanReplay:
    """Replays the events of one run, in seq order. ``done`` collects the spans that closed; ``next_id`` and the open
    spans are all that has to be kept between two parts of a run."""

    def __init__(self, next_id: int = 0, open_spans: list[dict] = ()):
        self.next_id = next_id
        self.open = OpenSpans(open_spans)
        self.done: list[dict] = []

    def feed(self, etype: str, seq: int, ts, agent, raw) -> None:
        data = _payload(raw)
        if etype in _OPENS:
            self._opened(etype, seq, ts, _given(agent, "agent"), data)
        elif etype in CLOSE_TYPE:
            self._closed(CLOSE_TYPE[etype], seq, ts, data)
        elif etype in _TEXT and (span := self.open.innermost("type", "llm")):
            span[_TEXT[etype]] += str(_given(data.get("text"), ""))

    def around(self) -> dict | None:
        """The innermost open span."""
        return self.open.innermost("any")

    def _opened(self, etype, seq, ts, agent, data) -> None:
        # A run is a root wherever it starts.
        around = None if _OPENS[etype][0] == "run" else self.around()
        span = _new_span(self.next_id, etype, seq, ts, agent, data, around)
        # [root, spans so far] of the tree, shared by its spans; it goes when none of them is open any more. A new
        # span's parent is the innermost open one, so within a tree the order of numbers is the pre-order.
        tree = (around.get("tree") if around else None) or [around["id"] if around else self.next_id, 0]
        span |= {"tree": tree, "nth": tree[1]}
        tree[1] += 1
        self.next_id += 1
        if span["kind"] == "metrics":  # a point, never open
            self.done.append(span | {"status": None})
        else:
            self.open.add(span)

    def _closed(self, kind, seq, ts, data) -> None:
        span = None
        if kind in ("tool", "agent") and isinstance(data.get("tool_use_id"), str):
            span = self.open.innermost("tool", data["tool_use_id"])
        span = span or self.open.innermost("type", kind)
        if span is None:
            return
        self.open.remove(span)
        self.done.append(self._close(span, kind, seq, ts, data))

    @staticmethod
    def _close(span: dict, kind, seq, ts, data) -> dict:
        """The span as an end of that kind closes it."""
        took = _number(data.get("duration_s")) if kind in PAYLOAD_DURATION else None
        if took is None:
            begin, end = _ms(span["start"]), _ms(ts)
            took = None if begin is None or end is None else max(0.0, (end - begin) / 1000)
        span |= {"end": ts, "end_seq": seq, "duration": took, "data": span["data"] | data,
                 "status": "error" if _FAILED[kind](data) else "success"}
        if kind == "llm" and span["data"].get("stop_reason"):
            span["name"] = f"LLM Call ({span['data']['stop_reason']})"
        return span


def _new_span(idx: int, etype: str, seq: int, ts, agent, data: dict, around: dict | None) -> dict:
    kind, name = _OPENS[etype]
    tool = data.get("tool_use_id")
    return {"id": idx, "kind": kind, "name": name(data, agent), "start_seq": seq, "end_seq": None,
            "start": ts, "end": None, "duration": None, "status": "running", "data": data,
            "parent": around and around["id"], "depth": around["depth"] + 1 if around else 0,
            "tool_use_id": tool if isinstance(tool, str) else None, "tokens": "", "reasoning": ""}


def span_row(run_id, n: dict, preorder) -> dict:
    return {
        "run_id": run_id, "span_id": f"n{n['id']}", "parent_id": None if n["parent"] is None else f"n{n['parent']}",
        "depth": n["depth"], "preorder": preorder, "span_type": n["kind"], "name": n["name"],
        "start_seq": n["start_seq"], "end_seq": n["end_seq"], "start_time": n["start"], "end_time": n["end"],
        "duration_s": n["duration"], "status": n["status"], "tool_use_id": n["tool_use_id"],
        "token_text": n["tokens"], "reasoning_text": n["reasoning"], "data": json.dumps(n["data"], sort_keys=True),
    }


SPAN_SCHEMA_NAMES = [c.strip().split(" ")[0] for c in SPAN_SCHEMA.split(",")]
_ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
#: Span rows with the tree they are in, and the part of their run that made them; preorder is the place in the tree's
#: spans of that part.
TREE_SPAN_SCHEMA = SPAN_SCHEMA + ", _run string, _root long, _part long"
_ARROW_SCHEMA = pa.schema([(c.split()[0], _ARROW_TYPES[c.split()[1]]) for c in TREE_SPAN_SCHEMA.split(", ")])
#: Span rows that leave a worker at once.
SPAN_ROWS = 4096
#: A run of more events than this is cut into parts.
RUN_EVENTS = 1 << 16
#: The part of a whole run, the first one of a cut run (others are named by the event they follow), and that of a cut
#: run's run spans, which come before all others of their trees.
WHOLE, FIRST, RUN_SPANS = -1, -2, -3


def _span_batches(key, run_id, part, spans: list[dict]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(spans), SPAN_ROWS):
        rows = [span_row(run_id, x, x["nth"]) | {"_run": key, "_root": x["tree"][0], "_part": x.get("part", part)}
                for x in spans[at:at + SPAN_ROWS]]
        for r in rows:
            if r["duration_s"] != r["duration_s"]:  # NaN
                r["duration_s"] = None
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_SCHEMA)


class PartReplay(SpanReplay):
    """Replays a part of a run that starts where nothing but run spans is open.

    Run spans are paired before the replay: a run_end brings the start that it closes and the run span that is innermost
    after it; the part's context names the one that is innermost at its start. So no part waits for another one.
    """

    def __init__(self):
        super().__init__()
        self.runs: dict[int, dict] = {}
        self.innermost_run: dict | None = None

    def enter(self, idx: int | None) -> None:
        """The run span of that number is the innermost one from here on (none: no run span is open)."""
        self.innermost_run = self.runs.setdefault(idx, {"id": idx, "depth": 0, "tree": [idx, 0]}) if idx is not None \
            else None

    def around(self) -> dict | None:
        found, run = self.open.innermost("any"), self.innermost_run
        return run if found is None or run is not None and run["id"] > found["id"] else found

    def run_start(self, idx: int, seq: int, ts, agent, raw, never_closed: bool) -> None:
        if never_closed:
            self.done.append(self._run_span(idx, seq, ts, agent, raw))
        self.enter(idx)

    def run_end(self, seq: int, ts, raw, start: dict, innermost: int | None) -> None:
        span = self._run_span(start["idx"], start["seq"], start["timestamp"], start["agent"], start["data"])
        self.done.append(self._close(span, "run", seq, ts, _payload(raw)))
        self.enter(innermost)

    @staticmethod
    def _run_span(idx, seq, ts, agent, raw) -> dict:
        span = _new_span(idx, "run_start", seq, ts, _given(agent, "agent"), _payload(raw), None)
        return span | {"tree": [idx, 0], "nth": 0, "part": RUN_SPANS}


_PART_COLUMNS = ("_run", "_part", "run_id", "type", "seq", "timestamp", "agent", "data", "idx", "start", "innermost",
                 "never_closed")


def replay_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replay events sorted by (run, part, seq) into span rows; closed spans leave with the batch that closed them, open
    ones as 'running' at the end of their part. Part WHOLE is a whole run."""
    at, replay, run_id = None, None, None
    for batch in batches:
        for key, part, run, etype, seq, ts, agent, raw, idx, start, innermost, never_closed in zip(
                *(batch.column(c).to_pylist() for c in _PART_COLUMNS)):
            if (key, part) != at:
                if replay is not None:
                    yield from _span_batches(at[0], run_id, at[1], [*replay.done, *replay.open.spans.values()])
                at, replay = (key, part), SpanReplay() if part == WHOLE else PartReplay()
            run_id = run
            if part == WHOLE:
                replay.feed(etype, seq, ts, agent, raw)
            elif etype == CONTEXT:
                replay.enter(innermost)
            elif etype == "run_start":
                replay.run_start(idx, seq, ts, agent, raw, never_closed)
            elif etype == "run_end":
                if start is not None:
                    replay.run_end(seq, ts, raw, start, innermost)
            else:
                replay.next_id = idx if idx is not None else replay.next_id
                replay.feed(etype, seq, ts, agent, raw)
        if replay is not None:
            yield from _span_batches(at[0], run_id, at[1], replay.done)
            replay.done.clear()
    if replay is not None:
        yield from _span_batches(at[0], run_id, at[1], list(replay.open.spans.values()))


#: The type of the row that stands before a part's events.
CONTEXT = "_context"
_START = "struct<idx:bigint,seq:bigint,timestamp:string,agent:string,data:string>"


def _keyed(events: DataFrame) -> DataFrame:
    """Events with ``_run``, a key of their run that is never null (a null run_id is a run of its own)."""
    key = F.when(F.col("run_id").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("run_id")))
    return events.select(key.alias("_run"), "run_id", "seq", "type", "agent", "timestamp", "data")


def _whole(events: DataFrame) -> DataFrame:
    """Rows for the replay of whole runs."""
    none = F.lit(None)
    return events.select("*", F.lit(WHOLE).cast("long").alias("_part"), none.cast("long").alias("idx"),
                         none.cast(_START).alias("start"), none.cast("long").alias("innermost"),
                         none.cast("boolean").alias("never_closed"))


def _odd_runs(events: DataFrame) -> DataFrame:
    """Runs in which a tool id may close a span of another type than its end names: it is on starts other than those
    of tools and agents, or is shared by both. Nothing tells what is open there but the replay itself."""
    kind = F.create_map(*[F.lit(x) for k, v in {**OPEN_TYPE, **CLOSE_TYPE}.items() for x in (k, v)])[F.col("type")]
    ids = events.where(F.col("type").isin(*OPEN_TYPE, "tool_end", "sub_agent_end")).select(
        "_run", kind.alias("kind"), F.get_json_object("data", "$.tool_use_id").alias("id")).where("id <> ''")
    of_id = ids.groupBy("_run", "id").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    return of_id.where("lo <> hi OR lo NOT IN ('tool', 'agent')").select("_run").distinct()


def _walks(events: DataFrame) -> DataFrame:
    """Events with ``idx`` (the span number of what they open), ``runs`` and ``runs_before`` (open run spans after and
    before them) and ``others`` (all other open spans after them).

    Where no tool id closes a span of another type, an end closes a span of its type if one is open, whichever. The
    number of open ones is then a running sum that never falls below 0: the sum less its lowest point so far. Both are
    made in two levels, chunk by chunk and then over the small table of chunks, so a long run is spread over tasks.
    """
    t = F.col("type")
    kinds = sorted(set(OPEN_TYPE.values()))
    opens = {v: k for k, v in OPEN_TYPE.items()}
    closes = {v: k for k, v in CLOSE_TYPE.items()}
    step = {k: F.when(t == opens[k], 1).when(t == closes[k], -1).otherwise(0).cast("bigint") for k in kinds}
    made = F.when(t.isin(*OPEN_TYPE) | (t == "metrics"), 1).otherwise(0).cast("bigint")
    rows = events.withColumn("_chunk", F.floor(F.col("seq") / F.lit(SEQ_CHUNK)))
    rows = rows.select("*", made.alias("made"), *[step[k].alias(f"d_{k}") for k in kinds])
    inside = Window.partitionBy("_run", "_chunk").orderBy("seq")
    upto, earlier = (inside.rowsBetween(Window.unboundedPreceding, x) for x in (0, -1))
    rows = rows.select("*", F.sum("made").over(upto).alias("n"), *[F.sum(f"d_{k}").over(upto).alias(f"s_{k}")
                                                                   for k in kinds])
    rows = rows.select("*", *[F.min(f"s_{k}").over(upto).alias(f"m_{k}") for k in kinds],
                       F.min("s_run").over(earlier).alias("m_before"))
    chunks = rows.groupBy("_run", "_chunk").agg(
        F.sum("made").alias("made"), *[F.sum(f"d_{k}").alias(f"t_{k}") for k in kinds],
        *[F.min(f"s_{k}").alias(f"low_{k}") for k in kinds])
    before = Window.partitionBy("_run").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("*", F.coalesce(F.sum("made").over(before), F.lit(0)).alias("n_in"),
                           *[F.coalesce(F.sum(f"t_{k}").over(before), F.lit(0)).alias(f"sum_{k}") for k in kinds])
    lowest = {k: F.min(F.col(f"sum_{k}") + F.col(f"low_{k}")).over(before) for k in kinds}
    chunks = chunks.select("_run", "_chunk", "n_in", *[
        (F.col(f"sum_{k}") - F.least(F.lit(0), F.coalesce(lowest[k], F.lit(0)))).alias(f"in_{k}") for k in kinds])

    def now(k: str, total: Column, low: Column) -> Column:
        return F.greatest(F.col(f"in_{k}") + total, total - F.least(F.lit(0), low))

    after = {k: now(k, F.col(f"s_{k}"), F.col(f"m_{k}")) for k in kinds}
    runs_before = now("run", F.col("s_run") - F.col("d_run"), F.coalesce("m_before", F.lit(0)))
    others = sum((after[k] for k in kinds if k != "run"), F.lit(0))
    return rows.join(chunks, ["_run", "_chunk"]).select(
        *events.columns, "_chunk", F.when(F.col("made") == 1, F.col("n_in") + F.col("n") - 1).alias("idx"),
        after["run"].alias("runs"), runs_before.alias("runs_before"), others.alias("others"))


def _cut_runs(events: DataFrame) -> DataFrame:
    """Rows for the replay of long runs in parts: a part ends at the first event of each chunk after which nothing but
    run spans is open."""
    walks = cut(_walks(events), "trace-walks")
    first = walks.groupBy("_run", "_chunk").agg(F.min(F.when(F.col("others") == 0, F.col("seq"))).alias("at"))
    before = Window.partitionBy("_run").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = cut(first.withColumn("earlier", F.last("at", ignorenulls=True).over(before)), "trace-parts")
    part = F.when(F.col("seq") > F.col("at"), F.col("at")).otherwise(F.coalesce("earlier", F.lit(FIRST))).cast("long")
    rows = walks.join(first, ["_run", "_chunk"]).withColumn("_part", part)

    # Run spans in pairs: an end closes the last start that opened as many run spans as are open before the end.
    starts = walks.where("type = 'run_start'")
    ends = walks.where("type = 'run_end' AND runs_before > 0")
    as_key = F.col("_run").alias("run_id")
    cands = starts.select(as_key, F.col("runs").alias("key"), "seq", F.col("idx").alias("cand"))
    closed = _as_of(cands, ends.select(as_key, F.col("runs_before").alias("key"), "seq", F.col("seq").alias("me")), "c")
    inner = _as_of(cands, ends.where("runs > 0").select(as_key, F.col("runs").alias("key"), "seq",
                                                        F.col("seq").alias("me")), "innermost")
    closed = cut(closed.select(F.col("run_id").alias("_run"), F.col("idx").alias("seq"), F.col("c").alias("closed")),
                 "trace-run-ends")
    inner = inner.select(F.col("run_id").alias("_run"), F.col("idx").alias("seq"), "innermost")
    started = starts.select("_run", F.col("idx").alias("closed"),
                            F.struct("idx", "seq", "timestamp", "agent", "data").cast(_START).alias("start"))
    of_end = closed.join(started, ["_run", "closed"]).join(inner, ["_run", "seq"], "left")
    of_end = cut(of_end.select("_run", "seq", "start", "innermost"), "trace-run-pairs")
    of_start = closed.select("_run", F.col("closed").alias("idx"), F.lit(False).alias("never_closed"))

    plain = ["_run", "run_id", "seq", "type", "agent", "timestamp", "data", "_part", "idx"]
    run_ends = rows.where("type = 'run_end'").select(*plain).join(of_end, ["_run", "seq"], "left")
    run_starts = rows.where("type = 'run_start'").select(*plain).join(of_start, ["_run", "idx"], "left")
    run_starts = run_starts.withColumn("never_closed", F.col("never_closed").isNull())
    others = rows.where("type NOT IN ('run_start', 'run_end')").select(*plain)

    # What is innermost where a part starts: as after the last run_start or run_end up to there.
    moves = starts.select(as_key, F.lit(0).alias("key"), (2 * F.col("seq")).alias("seq"), F.col("idx").alias("cand"))
    moves = moves.union(of_end.select(as_key, F.lit(0), 2 * F.col("seq"), F.coalesce("innermost", F.lit(-1))))
    parts = first.where("at IS NOT NULL").select("_run", "at")
    entered = _as_of(moves, parts.select(as_key, F.lit(0).alias("key"), (2 * F.col("at") + 1).alias("seq"),
                                         F.col("at").alias("me")), "innermost")
    context = entered.where("innermost >= 0").select(
        F.col("run_id").alias("_run"), F.col("idx").alias("_part"), F.col("idx").alias("seq"),
        F.lit(CONTEXT).alias("type"), "innermost")
    return others.unionByName(run_starts, allowMissingColumns=True).unionByName(
        run_ends, allowMissingColumns=True).unionByName(context, allowMissingColumns=True)


def trace_spans(events: DataFrame, run_events: int = RUN_EVENTS) -> DataFrame:
    """TR-1 / TR-3: one row per span of every run (exact stack replay).

    A run of up to ``run_events`` events is replayed by one task. Longer runs are cut where nothing but run spans is
    open, and their parts replayed on their own; a long run in which a tool id may close spans of several types is
    replayed whole, batch by batch.
    """
    ev = _keyed(events)
    sizes = ev.groupBy("_run").agg(F.count(F.lit(1)).alias("n"))
    long_runs = cut(sizes.where(F.col("n") > run_events).select("_run"), "trace-long-runs")
    rows = _whole(ev)
    if long_runs.limit(1).count():
        long_events = ev.join(long_runs, "_run", "left_semi")
        odd = cut(_odd_runs(long_events), "trace-odd-runs")
        whole = ev.join(long_runs.join(odd, "_run", "left_anti"), "_run", "left_anti")
        rows = _whole(whole).unionByName(_cut_runs(long_events.join(odd, "_run", "left_anti")),
                                         allowMissingColumns=True)
    rows = rows.select(*_PART_COLUMNS).repartition("_run", "_part").sortWithinPartitions("_run", "_part", "seq")
    spans = cut(rows.mapInArrow(replay_parts, TREE_SPAN_SCHEMA), "trace-spans")
    # A tree's spans come after those of all earlier roots, a part's after those of all earlier parts.
    trees = spans.groupBy("_run", "_root", "_part").agg(F.count(F.lit(1)).alias("_size"))
    trees = running_sums(trees, ["_run"], F.col("_root"), ["_root", "_part"], {"_upto": F.col("_size")},
                         chunk_width=SEQ_CHUNK)
    before = trees.select("_run", "_root", "_part", (F.col("_upto") - F.col("_size")).alias("_before"))
    placed = spans.join(before, ["_run", "_root", "_part"])
    preorder = (F.col("_before") + F.col("preorder")).cast("int").alias("preorder")
    return placed.select(*[preorder if c == "preorder" else F.col(c) for c in SPAN_SCHEMA_NAMES])


# ---- TR-2: Catalyst-only spans for well-nested runs ------------------------------------------------------

def _delta() -> Column:
    t = F.col("type")
    return (F.when(t.isin(*OPEN_TYPE), F.lit(1)).when(t.isin(*CLOSE_TYPE), F.lit(-1)).otherwise(F.lit(0))
            .cast("bigint"))


def _kind() -> Column:
    t = F.col("type")
    expr = F.when(t == "metrics", F.lit("metrics"))
    for k, v in {**OPEN_TYPE, **CLOSE_TYPE}.items():
        expr = expr.when(t == k, F.lit(v))
    return expr


def _levels(events: DataFrame) -> DataFrame:
    """Per event: depth after it, llm-depth after it and the creation index of spans (all running sums)."""
    t = F.col("type")
    ev = events.select("run_id", "seq", "type", "agent", "timestamp", "data")
    return running_sums(ev, ["run_id"], F.col("seq"), ["seq"], {
        "level_after": _delta(),
        "llm_after": F.when(t == "model_call_start", 1).when(t == "model_call_end", -1).otherwise(0).cast("bigint"),
        "created": F.when(t.isin(*OPEN_TYPE) | (t == "metrics"), 1).otherwise(0).cast("bigint"),
    }, chunk_width=SEQ_CHUNK)


def _as_of(cands: DataFrame, queries: DataFrame, out: str) -> DataFrame:
    """For each query row (run_id, key, seq, me): the last candidate (run_id, key, seq, cand) before it."""
    u = (cands.select("run_id", "key", "seq", "cand", F.lit(None).cast("bigint").alias("me"))
         .unionByName(queries.select("run_id", "key", "seq", F.lit(None).cast("bigint").alias("cand"), "me")))
    found = running_last(u, ["run_id", "key"], F.col("seq"), ["seq"], {out: F.col("cand")}, chunk_width=SEQ_CHUNK)
    return found.filter(F.col("me").isNotNull()).select("run_id", F.col("me").alias("idx"), out)


def trace_spans_native(events: DataFrame) -> DataFrame:
    """TR-2: the TR-1 rows for well-nested runs, without Python. Token / reasoning text is joined in order."""
    lv = _levelled(events)
    return _native(lv, _paired(lv))


def _levelled(events: DataFrame) -> DataFrame:
    """Events with their levels, written once for all that reads them."""
    lv = _levels(events).withColumn("kind", _kind())
    t = F.col("type")
    return cut(lv.withColumn("level", F.when(t.isin(*OPEN_TYPE), F.col("level_after") - 1).when(
        t.isin(*CLOSE_TYPE) | (t == "metrics"), F.col("level_after"))), "trace-levels")


def _paired(lv: DataFrame) -> DataFrame:
    """(run_id, level, kind, k, opening and closing event) of the k-th open and k-th close at each depth; points too."""
    is_open, is_close = F.col("type").isin(*OPEN_TYPE), F.col("type").isin(*CLOSE_TYPE)
    oc = running_sums(lv.filter(is_open | is_close | (F.col("type") == "metrics")), ["run_id", "level"],
                      F.col("seq"), ["seq"], {"k_open": F.when(is_open, 1).otherwise(0).cast("bigint"),
                                              "k_close": F.when(is_close, 1).otherwise(0).cast("bigint")},
                      chunk_width=SEQ_CHUNK)
    p = F.from_json(F.col("data"), "map<string,string>")
    opens = (oc.filter(is_open | (F.col("type") == "metrics"))
             .select("run_id", "kind", "level", F.col("created").alias("idx"), F.col("k_open").alias("k"),
                     F.col("seq").alias("start_seq"), F.col("timestamp").alias("start_time"),
                     F.col("agent").alias("start_agent"), p.alias("sp")))
    closes = (oc.filter(is_close)
              .select(F.col("run_id").alias("c_run_id"), F.col("level").alias("c_level"), F.col("k_close").alias("c_k"),
                      F.col("kind").alias("c_kind"), F.col("seq").alias("end_seq"),
                      F.col("timestamp").alias("end_time"), p.alias("ep")))
    spans = opens.join(closes, (F.col("run_id") == F.col("c_run_id")) & (F.col("level") == F.col("c_level"))
                       & (F.col("k") == F.col("c_k")) & (F.col("kind") != "metrics"), "left").drop("c_run_id")
    return cut(spans, "trace-pairs")


def _sunk(events: DataFrame) -> DataFrame:
    """Runs with an end where nothing is open (depth below 0), or a run_start below the top level. Told from the types
    and places of the events alone, before anything is made of their payloads."""
    depth = running_sums(events.select("run_id", "seq", "type"), ["run_id"], F.col("seq"), ["seq"], {"depth": _delta()},
                         chunk_width=SEQ_CHUNK)
    below = (F.col("depth") < 0) | ((F.col("type") == "run_start") & (F.col("depth") > 1))
    return cut(depth.filter(below).select("run_id").distinct(), "trace-sunk")


def _crossed(paired: DataFrame) -> DataFrame:
    """Runs with a pair whose end is of another type or names another tool id (a close from the middle)."""
    close_id = F.coalesce(F.col("ep").getItem("tool_use_id"), F.lit(""))
    mismatch = (F.col("end_seq").isNotNull()
                & ((F.col("c_kind") != F.col("kind"))
                   | (F.col("kind").isin("tool", "agent") & (close_id != "")
                      & ~close_id.eqNullSafe(F.col("sp").getItem("tool_use_id")))))
    return cut(paired.filter(mismatch).select("run_id").distinct(), "trace-crossed")


def _native(lv: DataFrame, spans: DataFrame) -> DataFrame:
    """Catalyst-only span rows of well-nested runs, from their levelled events and pairs.

    The parent of an open at depth L is the last open at depth L-1 before it, and the LLM call a token
    belongs to is the last model_call_start at the current LLM depth: both are as-of lookups keyed by
    (run, depth), done with the chunked ``running_last``. The k-th open at a depth pairs with the k-th close
    at that depth (chunked running counts + an equi-join), so no step holds a whole run in one task.
    """
    is_open = F.col("type").isin(*OPEN_TYPE)
    parents = _as_of(
        lv.filter(is_open).select("run_id", (F.col("level") + 1).alias("key"), "seq", F.col("created").alias("cand")),
        lv.filter((is_open & (F.col("kind") != "run") & (F.col("level") > 0))
                  | ((F.col("type") == "metrics") & (F.col("level") > 0)))
          .select("run_id", F.col("level").alias("key"), "seq", F.col("created").alias("me")),
        "parent_idx")
    llm_of = _as_of(
        lv.filter(F.col("type") == "model_call_start")
          .select("run_id", F.col("llm_after").alias("key"), "seq", F.col("created").alias("cand")),
        lv.filter(F.col("type").isin("token", "reasoning") & (F.col("llm_after") > 0))
          .select("run_id", F.col("llm_after").alias("key"), "seq", F.col("seq").alias("me")),
        "llm_idx").withColumnRenamed("idx", "seq")
    lv_text = lv.filter(F.col("type").isin("token", "reasoning")).join(llm_of, ["run_id", "seq"])

    texts = (lv_text.select("run_id", F.col("llm_idx").alias("idx"), "seq", "type",
                            F.coalesce(F.get_json_object("data", "$.text"), F.lit("")).alias("text"))
             .groupBy("run_id", "idx")
             .agg(F.collect_list(F.when(F.col("type") == "token", F.struct("seq", "text"))).alias("tok"),
                  F.collect_list(F.when(F.col("type") == "reasoning", F.struct("seq", "text"))).alias("rea")))
    spans = spans.join(parents, ["run_id", "idx"], "left").join(texts, ["run_id", "idx"], "left")

    kind, sp, ep = F.col("kind"), F.col("sp"), F.col("ep")
    closed = F.col("end_seq").isNotNull()
    agent_or = lambda key: F.coalesce(sp.getItem(key), F.col("start_agent"), F.lit("agent"))
    base_name = (F.when(kind == "run", F.concat(F.lit("Run: "), agent_or("agent_type")))
                 .when(kind == "invocation", F.concat(F.lit("Invocation: "), agent_or("agent_name")))
                 .when(kind == "llm", F.lit("LLM Call"))
                 .when(kind == "tool", F.concat(F.lit("Tool: "), F.coalesce(sp.getItem("tool_name"), F.lit("unknown"))))
                 .when(kind == "agent", F.concat(F.lit("Agent: "),
                                                 F.coalesce(sp.getItem("sub_agent_name"), F.lit("unknown"))))
                 .otherwise(F.lit("Final Metrics")))
    # end payload keys override start payload keys (also with a null value)
    stop = F.when(F.map_contains_key(ep, "stop_reason"), ep.getItem("stop_reason")).otherwise(sp.getItem("stop_reason"))
    name = F.when((kind == "llm") & closed & stop.isNotNull() & (stop != ""),
                  F.concat(F.lit("LLM Call ("), stop, F.lit(")"))).otherwise(base_name)
    computed = millis_between(F.col("start_time").try_cast("timestamp"), F.col("end_time").try_cast("timestamp"))
    duration = F.when(closed, F.when(kind.isin(*PAYLOAD_DURATION) & ep.getItem("duration_s").isNotNull(),
                                     ep.getItem("duration_s").try_cast("double")).otherwise(computed))
    truthy = ~F.coalesce(ep.getItem("success"), F.lit("false")).isin("false", "0", "0.0", "", "null")
    status = (F.when(kind == "metrics", F.lit(None))
              .when(~closed, F.lit("running"))
              .when(kind == "run", F.when(truthy, "success").otherwise("error"))
              .when(kind == "llm", F.when(F.coalesce(ep.getItem("error"), F.lit("")) != "", "error").otherwise("success"))
              .when(kind.isin("tool", "agent"),
                    F.when(ep.getItem("status") == "error", "error").otherwise("success"))
              .otherwise(F.lit("success")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.col(c)), lambda s: s["text"]), "")
    rows = spans.select(
        "run_id", F.concat(F.lit("n"), (F.col("idx") - 1).cast("string")).alias("span_id"),
        F.when(F.col("parent_idx").isNotNull(), F.concat(F.lit("n"), (F.col("parent_idx") - 1).cast("string")))
        .alias("parent_id"),
        F.col("level").cast("int").alias("depth"),
        (F.col("idx") - 1).cast("int").alias("preorder"),
        F.col("kind").alias("span_type"), name.alias("name"), "start_seq", "end_seq", "start_time", "end_time",
        duration.alias("duration_s"), status.alias("status"), sp.getItem("tool_use_id").alias("tool_use_id"),
        F.coalesce(joined("tok"), F.lit("")).alias("token_text"),
        F.coalesce(joined("rea"), F.lit("")).alias("reasoning_text"))
    return rows


def trace_spans_hybrid(events: DataFrame) -> DataFrame:
    """TR-1 rows for every run. Runs are told apart before any span is built: well-nested ones take the Catalyst-only
    path (no step holds a whole run); runs where the stack is disturbed (unmatched ends, closes from the middle, tool-id
    mismatches), and events without a run_id, go to the exact replay. Each run takes one path only, and a path that no
    run takes is left out."""
    ev = events.select("run_id", "seq", "type", "agent", "timestamp", "data")
    named = ev.where("run_id IS NOT NULL")
    sunk = _sunk(named)
    if named.select("run_id").join(sunk, "run_id", "left_anti").isEmpty():
        return trace_spans(ev).select(*SPAN_COLS)
    lv = _levelled(named.join(sunk, "run_id", "left_anti"))
    paired = _paired(lv)
    crossed = _crossed(paired)
    good = _native(lv.join(crossed, "run_id", "left_anti"), paired.join(crossed, "run_id", "left_anti"))
    bad = sunk.union(crossed)
    nameless = ev.where("run_id IS NULL")
    if bad.isEmpty() and nameless.isEmpty():
        return good
    rest = ev.join(bad, "run_id", "left_semi").unionByName(nameless)
    return good.unionByName(trace_spans(rest).select(*SPAN_COLS))


# ---- WI-2 / AG-11 / AG-14 / TR-4 ----------------------------------------------------------------------------

def reasoning_blocks(events: DataFrame) -> DataFrame:
    """WI-2 / TR-5: every reasoning event is a block (also with no open LLM call), numbered per run, with the
    number of invocation_start events seen so far."""
    t = F.col("type")
    ev = events.select("run_id", "seq", "type", "timestamp", "data")
    counted = running_sums(ev, ["run_id"], F.col("seq"), ["seq"], {
        "invocation_idx": F.when(t == "invocation_start", 1).otherwise(0).cast("bigint"),
        "_n": F.when(t == "reasoning", 1).otherwise(0).cast("bigint"),
    }, chunk_width=SEQ_CHUNK)
    return (counted.filter(t == "reasoning")
            .select("run_id", F.concat(F.lit("rb_"), (F.col("_n") - 1).cast("string")).alias("block_id"), "seq",
                    "invocation_idx", F.coalesce(F.get_json_object("data", "$.text"), F.lit("")).alias("text"),
                    "timestamp"))


def reasoning_summary(blocks: DataFrame) -> DataFrame:
    """AG-14: block count and all block texts joined with a rule, per run."""
    # fixed value that must equal the reference: the separator between reasoning blocks
    sep = "\n\n---\n\n"
    return (blocks.groupBy("run_id")
            .agg(F.count(F.lit(1)).alias("n_blocks"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]),
                              sep).alias("text")))


def llm_text(spans: DataFrame) -> DataFrame:
    """AG-11 / AG-13: the accumulated text of every LLM call and its length in characters."""
    return (spans.filter(F.col("span_type") == "llm")
            .select("run_id", "span_id", "name", "token_text", F.char_length("token_text").alias("text_length"),
                    "reasoning_text"))


def timeline(spans: DataFrame, now: Column) -> DataFrame:
    """TR-4 (AG-12, WI-4): bar position of every span as left% / width% of the run's time range.

    Range = earliest start .. latest end of the run in ms (at least 1 ms); a span with no end runs to ``now``;
    a bar is at least 0.5% wide. The per-run bounds are a groupBy joined back on run_id.
    """
    ms = lambda c: F.floor(F.unix_micros(F.col(c).try_cast("timestamp")) / 1000)
    s = spans.select("run_id", "span_id", "depth", "preorder", "name", ms("start_time").alias("s_ms"),
                     ms("end_time").alias("e_ms"))
    now_ms = F.floor(F.unix_micros(now) / 1000)
    b = s.groupBy("run_id").agg(F.min("s_ms").alias("min_ms"), F.max("e_ms").alias("max_ms"))
    j = s.join(b, "run_id")
    lo = F.coalesce(F.col("min_ms"), F.lit(0))
    hi = F.coalesce(F.col("max_ms"), now_ms)
    total = F.greatest(hi - lo, F.lit(1)).cast("double")
    start = F.coalesce(F.col("s_ms"), lo)
    end = F.coalesce(F.col("e_ms"), now_ms)
    return j.select("run_id", "span_id", "depth", "preorder", "name",
                    ((start - lo).cast("double") / total * F.lit(100.0)).alias("left_pct"),
                    F.greatest((end - start).cast("double") / total * F.lit(100.0), F.lit(0.5)).alias("width_pct"))
