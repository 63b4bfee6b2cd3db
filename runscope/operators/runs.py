"""Part D (batch): the event log folded into the runs table, plus run listing, search and token / tool metrics.

The fold is a single ``groupBy(run_id)`` whose aggregates are ``max(struct(seq, ...))`` per event kind:
partial aggregation keeps one candidate per kind per task, so a run with a third of all events is reduced
map-side before the shuffle, and the same expression runs unchanged as a streaming ``update`` aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.functions.columns import cost_units, micro_usd, run_status
from runscope.operators.sequences import running_previous
from runscope.schemas import PAYLOAD

#: Width in seq of a chunk of the look-up of earlier events.
SEQ_CHUNK = 1 << 16


def parse_events(events: DataFrame) -> DataFrame:
    """Event envelope -> + ``p`` (typed payload struct), ``ts`` (UTC timestamp), ``has_metrics``."""
    metrics_raw = F.get_json_object(F.col("data"), "$.metrics")
    return events.select(
        "*",
        F.from_json(F.col("data"), PAYLOAD).alias("p"),
        F.col("timestamp").try_cast("timestamp").alias("ts"),
        (metrics_raw.isNotNull() & (F.regexp_replace(metrics_raw, r"\s", "") != "{}")).alias("has_metrics"),
    )


def _last(kind_filter: Column, *fields: Column) -> Column:
    """The fields of the kind's event with the largest seq (NULL if the run has none)."""
    return F.max(F.when(kind_filter, F.struct(F.col("seq").alias("seq"), *fields)))


def fold_aggregates(reset: bool = False) -> list[Column]:
    t = F.col("type")
    inv = (t == "invocation_end") & F.col("has_metrics")
    if reset:  # the live view only takes metrics with a non-zero input token count
        inv = inv & (F.coalesce(F.col("p.metrics.input_tokens"), F.lit(0)) != 0)
    return [
        F.min(F.when(t == "run_start", F.col("seq"))).alias("first_start"),
        _last(t == "run_start", F.coalesce(F.col("p.agent_type"), F.col("agent")).alias("agent_type"),
              F.col("timestamp").alias("started_at")).alias("rs"),
        _last(t == "run_end", F.col("timestamp").alias("ended_at"),
              F.when(F.coalesce(F.col("p.success"), F.lit(False)), 1).otherwise(0).alias("success"),
              F.col("p.duration_s").alias("duration_s")).alias("re"),
        _last(inv, F.coalesce(F.col("p.metrics.input_tokens"), F.lit(0)).alias("in_tok"),
              F.coalesce(F.col("p.metrics.output_tokens"), F.lit(0)).alias("out_tok"),
              F.col("p.metrics.estimated_cost_usd").alias("cost")).alias("ie"),
    ]


def fold_select(reset: bool = False) -> list[Column]:
    """Gate every 'last event of a kind' on following the first run_start (or, in reset mode, the last one:
    each run_start starts a fresh record); map success to the status."""
    fs = F.col("rs.seq") if reset else F.col("first_start")
    after = lambda c: F.col(f"{c}.seq") > fs
    success = F.when(after("re"), F.col("re.success"))
    return [
        "run_id", F.col("rs.agent_type").alias("agent_type"), F.col("rs.started_at").alias("started_at"),
        F.when(after("re"), F.col("re.ended_at")).alias("ended_at"), success.alias("success"),
        F.when(after("ie"), F.col("ie.in_tok")).otherwise(0).cast("bigint").alias("total_input_tokens"),
        F.when(after("ie"), F.col("ie.out_tok")).otherwise(0).cast("bigint").alias("total_output_tokens"),
        F.when(after("re"), F.col("re.duration_s")).alias("total_duration_s"),
        F.when(after("ie"), F.col("ie.cost")).alias("estimated_cost_usd"),
        run_status(success).alias("status"),
    ]


def runs_table(events: DataFrame, token_mode: str = "last") -> DataFrame:
    """AG-7 / ST-2 / PR-10: one row per run that has a run_start.

    run_start sets agent_type and started_at (last one wins); run_end sets ended_at, success and duration and
    invocation_end with metrics replaces tokens and cost -- each only counts when it follows the first
    run_start (before that the run row does not exist yet). ``token_mode='sum'`` adds up all invocations
    after the first run_start instead (an orchestrator and its sub-agent share one provider, so last-wins
    under-counts); that needs first_start before the sums, so it is a second aggregate joined on run_id.
    ``token_mode='reset'`` is the live view's variant: every run_start resets the record, so only events after
    the last run_start count, and metrics count only with a non-zero input token count.
    """
    parsed = events if "p" in events.columns else parse_events(events)
    reset = token_mode == "reset"
    runs = (parsed.groupBy("run_id").agg(*fold_aggregates(reset))
            .filter(F.col("first_start").isNotNull()).select(*fold_select(reset)))
    if token_mode in ("last", "reset"):
        return runs
    starts = (parsed.filter(F.col("type") == "run_start").groupBy("run_id")
              .agg(F.min("seq").alias("first_start")))
    inv = (parsed.filter((F.col("type") == "invocation_end") & F.col("has_metrics"))
           .join(starts, "run_id").filter(F.col("seq") > F.col("first_start"))
           .groupBy("run_id")
           .agg(F.sum(F.coalesce(F.col("p.metrics.input_tokens"), F.lit(0))).cast("bigint").alias("in_sum"),
                F.sum(F.coalesce(F.col("p.metrics.output_tokens"), F.lit(0))).cast("bigint").alias("out_sum"),
                F.sum(F.col("p.metrics.estimated_cost_usd").cast("decimal(20,6)")).cast("double").alias("cost_sum")))
    return (runs.join(inv, "run_id", "left")
            .select("run_id", "agent_type", "started_at", "ended_at", "success",
                    F.coalesce("in_sum", F.lit(0)).cast("bigint").alias("total_input_tokens"),
                    F.coalesce("out_sum", F.lit(0)).cast("bigint").alias("total_output_tokens"),
                    "total_duration_s", F.col("cost_sum").alias("estimated_cost_usd"), "status"))


def recent_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """SO-1: newest runs first (started_at DESC, run_id as tie-break); a top-k, planned as TakeOrdered."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)


def search_runs(runs: DataFrame, query: str = "", status: str = "all") -> DataFrame:
    """FI-4 / FI-5: case-insensitive substring on agent_type or run_id, then the status filter."""
    out = runs
    if query:
        q = query.lower()
        out = out.filter(F.lower("agent_type").contains(q) | F.lower("run_id").contains(q))
    if status != "all":
        out = out.filter(F.col("status") == status)
    return out


def live_runs(runs: DataFrame, now: Column) -> DataFrame:
    """ST-4 / ST-5 / TR-6: runs still running, with elapsed seconds = now - started_at."""
    started = F.col("started_at").try_cast("timestamp")
    return (runs.filter(F.col("status") == "running")
            .select("run_id", "agent_type", "started_at",
                    ((F.unix_micros(now) - F.unix_micros(started)) / F.lit(1e6)).alias("elapsed_s")))


def run_events(events: DataFrame, run_id: str) -> DataFrame:
    """FI-6 / SO-2: the events of one run in arrival order."""
    return events.filter(F.col("run_id") == run_id).orderBy("seq")


def invocation_usage(events: DataFrame) -> DataFrame:
    """AG-9 / PR-11: token usage of every invocation_end with metrics, with the cost recomputed exactly."""
    parsed = events if "p" in events.columns else parse_events(events)
    m = "p.metrics"
    units = cost_units(F.col(f"{m}.input_tokens"), F.col(f"{m}.output_tokens"), F.col(f"{m}.cache_read_tokens"),
                       F.col(f"{m}.cache_write_tokens"))
    return (parsed.filter((F.col("type") == "invocation_end") & F.col("has_metrics"))
            .select("run_id", "seq",
                    *[F.coalesce(F.col(f"{m}.{c}"), F.lit(0)).alias(c) for c in
                      ["input_tokens", "output_tokens", "total_tokens", "cache_read_tokens", "cache_write_tokens",
                       "latency_ms", "cycle_count"]],
                    micro_usd(units).alias("cost_micro_usd"),
                    F.col(f"{m}.estimated_cost_usd").alias("reported_cost_usd")))


def token_usage(events: DataFrame) -> DataFrame:
    """AG-9: per-run totals over all invocations (map-side partial sums)."""
    u = invocation_usage(events)
    sums = ["input_tokens", "output_tokens", "total_tokens", "cache_read_tokens", "cache_write_tokens",
            "latency_ms", "cycle_count"]
    return (u.groupBy("run_id")
            .agg(F.count(F.lit(1)).alias("n_invocations"), *[F.sum(c).cast("bigint").alias(c) for c in sums],
                 (F.sum("cost_micro_usd").cast("double") / F.lit(1e6)).alias("cost_usd")))


def tool_metrics(events: DataFrame) -> DataFrame:
    """AG-8: per invocation and tool: calls, successes, errors, total time and average time per call."""
    parsed = events if "p" in events.columns else parse_events(events)
    ex = (parsed.filter((F.col("type") == "invocation_end") & F.col("p.metrics.tools").isNotNull())
          .select("run_id", "seq", F.explode("p.metrics.tools").alias("tool_name", "m")))
    calls = F.col("m.call_count")
    return ex.select("run_id", "seq", "tool_name", calls.alias("call_count"),
                     F.col("m.success_count").alias("success_count"), F.col("m.error_count").alias("error_count"),
                     F.col("m.total_time_s").alias("total_time_s"),
                     F.when(calls > 0, F.col("m.total_time_s") / calls.cast("double")).alias("avg_time_s"))


def tool_calls(events: DataFrame) -> DataFrame:
    """JO-2: tool starts paired with their ends on (run_id, tool_use_id).

    Like the emitter's start-time map (set on start, popped on end), an end pairs with the previous event of
    the same id if that event is a start; otherwise it has no start. Duration is end - start in seconds,
    rounded half-up to 2 places on exact microseconds.
    """
    parsed = events if "p" in events.columns else parse_events(events)
    tl = (parsed.filter(F.col("type").isin("tool_start", "tool_end", "sub_agent_start", "sub_agent_end"))
          .select("run_id", "seq", "type", "ts", F.coalesce(F.col("p.tool_use_id"), F.lit("")).alias("tool_use_id"),
                  F.coalesce(F.col("p.tool_name"), F.col("p.sub_agent_name")).alias("tool_name"),
                  F.col("p.status").alias("status")))
    # The empty id may stand on very many events of a run: the event before is looked up chunk by chunk.
    tl = running_previous(tl, ["run_id", "tool_use_id"], F.col("seq"), ["seq"], F.struct("seq", "type", "ts"), "prev",
                          chunk_width=SEQ_CHUNK)
    ends = tl.filter(F.col("type").isin("tool_end", "sub_agent_end"))
    paired = F.col("prev.type").isin("tool_start", "sub_agent_start")
    micros = F.unix_micros(F.col("ts")) - F.unix_micros(F.col("prev.ts"))
    return ends.select(
        "run_id", "tool_use_id", "tool_name",
        F.when(paired, F.col("prev.seq")).alias("start_seq"), F.col("seq").alias("end_seq"), "status",
        F.when(paired, F.floor((micros + F.lit(5000)) / F.lit(10000)).cast("double") / F.lit(100.0))
        .alias("duration_s"))


def orphan_events(events: DataFrame, runs: DataFrame) -> DataFrame:
    """JO-5: events whose run_id has no row in the runs table (no run_start), counted per run_id.
    A left-anti join on run_id; the runs side is one row per run."""
    return (events.join(runs.select("run_id"), "run_id", "left_anti")
            .groupBy("run_id").agg(F.count(F.lit(1)).alias("n_events")))
