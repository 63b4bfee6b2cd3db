"""Registered queries for part D (telemetry, batch) over the event binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from runscope.operators import runs as R
from runscope.plans import oracle as O
from runscope.plans.registry import register
from runscope.sources import bindings as B

NOW = "2024-02-01 00:00:00"

EV = """
ev AS (
  SELECT event_id AS seq, 'run-' || CAST(user_id AS VARCHAR) AS run_id,
         CASE event_type WHEN 'signup' THEN 'run_start' WHEN 'click' THEN 'tool_start' WHEN 'view' THEN 'tool_end'
              WHEN 'purchase' THEN 'invocation_end' ELSE 'run_end' END AS type,
         CASE WHEN user_id % 2 = 0 THEN 'ticket' ELSE 'code-fix' END AS agent,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS timestamp, ts, value,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events
)"""

INV = """
inv AS (
  SELECT run_id, seq, k * 100 + 7 AS input_tokens, k * 37 + seq % 1000 AS output_tokens,
         k * 100 + 7 + k * 37 + seq % 1000 AS total_tokens, k * 10 AS cache_read_tokens,
         (k % 7) * 100 AS cache_write_tokens, seq % 5000 AS latency_ms, k % 5 + 1 AS cycle_count,
         CAST(floor(((k * 100 + 7) * 300 + (k * 37 + seq % 1000) * 1500 + (k * 10) * 30 + ((k % 7) * 100) * 375 + 50)
                    / 100) AS BIGINT) AS cost_micro_usd
  FROM ev WHERE type = 'invocation_end' AND k % 5 <> 0
)"""

RUNS = """
fs AS (SELECT run_id, min(seq) AS first_start FROM ev WHERE type = 'run_start' GROUP BY run_id),
ls AS (
  SELECT run_id, agent AS agent_type, timestamp AS started_at FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS rn FROM ev WHERE type = 'run_start')
  WHERE rn = 1
),
le AS (
  SELECT run_id, timestamp AS ended_at, CASE WHEN value >= 100 THEN 1 ELSE 0 END AS success,
         CASE WHEN k % 4 <> 0 THEN value END AS duration_s FROM (
    SELECT ev.*, row_number() OVER (PARTITION BY ev.run_id ORDER BY seq DESC) AS rn
    FROM ev JOIN fs USING (run_id) WHERE type = 'run_end' AND seq > first_start)
  WHERE rn = 1
),
li AS (
  SELECT run_id, input_tokens, output_tokens, CAST(cost_micro_usd AS DOUBLE) / 1e6 AS cost FROM (
    SELECT inv.*, row_number() OVER (PARTITION BY inv.run_id ORDER BY seq DESC) AS rn
    FROM inv JOIN fs USING (run_id) WHERE seq > first_start)
  WHERE rn = 1
),
runs AS (
  SELECT fs.run_id, ls.agent_type, ls.started_at, le.ended_at, le.success,
         coalesce(li.input_tokens, 0) AS total_input_tokens, coalesce(li.output_tokens, 0) AS total_output_tokens,
         le.duration_s AS total_duration_s, li.cost AS estimated_cost_usd,
         CASE WHEN le.success IS NULL THEN 'running' WHEN le.success = 1 THEN 'success' ELSE 'error' END AS status
  FROM fs JOIN ls USING (run_id) LEFT JOIN le USING (run_id) LEFT JOIN li USING (run_id)
)"""

RUN_CTES = [EV, INV, RUNS]


def events(spark, sf_dir):
    return R.parse_events(B.telemetry_events(spark, sf_dir))


@register("runs", O.with_ctes(RUN_CTES, "SELECT * FROM runs"), "AG-7 PR-10 ST-2 IO-10")
def q_runs(spark, sf_dir):
    return R.runs_table(events(spark, sf_dir))


@register("runs_summed_tokens", O.with_ctes(RUN_CTES + ["""
sums AS (
  SELECT run_id, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o,
         CAST(sum(CAST(CAST(cost_micro_usd AS DOUBLE) / 1e6 AS DECIMAL(20,6))) AS DOUBLE) AS c
  FROM inv JOIN fs USING (run_id) WHERE seq > first_start GROUP BY run_id
)"""], """
SELECT run_id, agent_type, started_at, ended_at, success, coalesce(i, 0) AS total_input_tokens,
       coalesce(o, 0) AS total_output_tokens, total_duration_s, c AS estimated_cost_usd, status
FROM runs LEFT JOIN sums USING (run_id)"""), "AG-7 AG-9")
def q_runs_summed(spark, sf_dir):
    return R.runs_table(events(spark, sf_dir), token_mode="sum")


@register("recent_runs", O.with_ctes(RUN_CTES, "SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 50"),
          "SO-1")
def q_recent_runs(spark, sf_dir):
    return R.recent_runs(R.runs_table(events(spark, sf_dir)), 50)


@register("run_search", O.with_ctes(RUN_CTES, """
SELECT * FROM runs WHERE (contains(lower(agent_type), '1') OR contains(lower(run_id), '1')) AND status = 'error'"""),
          "FI-4 FI-5")
def q_run_search(spark, sf_dir):
    return R.search_runs(R.runs_table(events(spark, sf_dir)), query="1", status="error")


@register("live_runs", O.with_ctes(RUN_CTES, f"""
SELECT run_id, agent_type, started_at,
       CAST(epoch_us(TIMESTAMP '{NOW}') - epoch_us(CAST(replace(started_at, '+00:00', '') AS TIMESTAMP)) AS DOUBLE)
         / 1e6 AS elapsed_s
FROM runs WHERE status = 'running'"""), "ST-4 ST-5")
def q_live_runs(spark, sf_dir):
    return R.live_runs(R.runs_table(events(spark, sf_dir)), F.lit(NOW + "+00:00").cast("timestamp"))


@register("run_events", O.with_ctes([EV], "SELECT seq, run_id, type, agent, timestamp FROM ev WHERE run_id = 'run-7'"),
          "FI-6 SO-2")
def q_run_events(spark, sf_dir):
    return R.run_events(B.telemetry_events(spark, sf_dir), "run-7").select("seq", "run_id", "type", "agent",
                                                                           "timestamp")


@register("invocation_usage", O.with_ctes([EV, INV], """
SELECT *, CAST(cost_micro_usd AS DOUBLE) / 1e6 AS reported_cost_usd FROM inv"""), "AG-9 PR-11")
def q_invocation_usage(spark, sf_dir):
    return R.invocation_usage(events(spark, sf_dir))


@register("token_usage", O.with_ctes([EV, INV], """
SELECT run_id, COUNT(*) AS n_invocations, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
       CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
       CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, CAST(sum(latency_ms) AS BIGINT) AS latency_ms,
       CAST(sum(cycle_count) AS BIGINT) AS cycle_count, CAST(sum(cost_micro_usd) AS DOUBLE) / 1e6 AS cost_usd
FROM inv GROUP BY run_id"""), "AG-9")
def q_token_usage(spark, sf_dir):
    return R.token_usage(events(spark, sf_dir))


@register("tool_metrics", O.with_ctes([EV], """
SELECT run_id, seq, 'tool_' || CAST(k % 5 AS VARCHAR) AS tool_name, k % 4 + 1 AS call_count,
       k % 4 + 1 - k % 2 AS success_count, k % 2 AS error_count, value AS total_time_s,
       value / CAST(k % 4 + 1 AS DOUBLE) AS avg_time_s
FROM ev WHERE type = 'invocation_end' AND k % 5 <> 0"""), "AG-8")
def q_tool_metrics(spark, sf_dir):
    return R.tool_metrics(events(spark, sf_dir))


@register("tool_calls", O.with_ctes([EV, """
tl AS (
  SELECT run_id, seq, type, ts, CASE WHEN k % 10 = 0 THEN '' ELSE 'tu_' || CAST(k AS VARCHAR) END AS tool_use_id,
         'tool_' || CAST(k % 5 AS VARCHAR) AS tool_name,
         CASE WHEN type = 'tool_end' THEN CASE WHEN k % 7 = 0 THEN 'error' ELSE 'success' END END AS status
  FROM ev WHERE type IN ('tool_start', 'tool_end')
),
lagged AS (
  SELECT *, lag(type) OVER w AS prev_type, lag(seq) OVER w AS prev_seq, lag(ts) OVER w AS prev_ts
  FROM tl WINDOW w AS (PARTITION BY run_id, tool_use_id ORDER BY seq)
)"""], """
SELECT run_id, tool_use_id, tool_name, CASE WHEN prev_type = 'tool_start' THEN prev_seq END AS start_seq,
       seq AS end_seq, status,
       CASE WHEN prev_type = 'tool_start'
            THEN CAST(floor((epoch_us(ts) - epoch_us(prev_ts) + 5000) / 10000) AS DOUBLE) / 100.0 END AS duration_s
FROM lagged WHERE type = 'tool_end'"""), "JO-2")
def q_tool_calls(spark, sf_dir):
    return R.tool_calls(events(spark, sf_dir))


@register("orphan_events", O.with_ctes(RUN_CTES, """
SELECT run_id, COUNT(*) AS n_events FROM ev
WHERE type <> 'run_start' AND (run_id LIKE '%3' OR run_id NOT IN (SELECT run_id FROM runs)) GROUP BY run_id"""),
          "JO-5")
def q_orphan_events(spark, sf_dir):
    # The start events of the runs whose id ends in 3 got lost on the way: all their other events are orphans.
    ev = B.telemetry_events(spark, sf_dir).where("NOT (type = 'run_start' AND run_id LIKE '%3')")
    return R.orphan_events(ev, R.runs_table(R.parse_events(ev)))


RESET = """
lsr AS (SELECT run_id, max(seq) AS last_start FROM ev WHERE type = 'run_start' GROUP BY run_id),
lss AS (SELECT ev.run_id, ev.agent AS agent_type, ev.timestamp AS started_at FROM ev JOIN lsr
        ON ev.run_id = lsr.run_id AND ev.seq = lsr.last_start),
lse AS (
  SELECT run_id, timestamp AS ended_at, CASE WHEN value >= 100 THEN 1 ELSE 0 END AS success,
         CASE WHEN k % 4 <> 0 THEN value END AS duration_s FROM (
    SELECT ev.*, row_number() OVER (PARTITION BY ev.run_id ORDER BY seq DESC) AS rn
    FROM ev JOIN lsr USING (run_id) WHERE type = 'run_end' AND seq > last_start)
  WHERE rn = 1
),
lsi AS (
  SELECT run_id, input_tokens, output_tokens, CAST(cost_micro_usd AS DOUBLE) / 1e6 AS cost FROM (
    SELECT inv.*, row_number() OVER (PARTITION BY inv.run_id ORDER BY seq DESC) AS rn
    FROM inv JOIN lsr USING (run_id) WHERE seq > last_start AND input_tokens <> 0)
  WHERE rn = 1
)"""


@register("runs_reset", O.with_ctes([EV, INV, RESET], """
SELECT lsr.run_id, lss.agent_type, lss.started_at, lse.ended_at, lse.success,
       coalesce(lsi.input_tokens, 0) AS total_input_tokens, coalesce(lsi.output_tokens, 0) AS total_output_tokens,
       lse.duration_s AS total_duration_s, lsi.cost AS estimated_cost_usd,
       CASE WHEN lse.success IS NULL THEN 'running' WHEN lse.success = 1 THEN 'success' ELSE 'error' END AS status
FROM lsr JOIN lss USING (run_id) LEFT JOIN lse USING (run_id) LEFT JOIN lsi USING (run_id)"""), "AG-7 ST-2")
def q_runs_reset(spark, sf_dir):
    return R.runs_table(events(spark, sf_dir), token_mode="reset")


@register("live_runs_reset", O.with_ctes([EV, INV, RESET], f"""
SELECT lsr.run_id, lss.agent_type, lss.started_at,
       CAST(epoch_us(TIMESTAMP '{NOW}') - epoch_us(CAST(replace(lss.started_at, '+00:00', '') AS TIMESTAMP)) AS DOUBLE)
         / 1e6 AS elapsed_s
FROM lsr JOIN lss USING (run_id) LEFT JOIN lse USING (run_id) WHERE lse.success IS NULL"""), "ST-4 ST-5")
def q_live_runs_reset(spark, sf_dir):
    """Live runs as the live view sees them: a run_start (re)opens a run until a run_end follows it."""
    return R.live_runs(R.runs_table(events(spark, sf_dir), token_mode="reset"), F.lit(NOW + "+00:00").cast("timestamp"))


# Runs whose end event got lost on the way stay running.
EV_LOST = EV.rstrip().removesuffix(")") + "  WHERE NOT (event_type = 'error' AND user_id % 10 = 7)\n)"


@register("live_runs_lost_ends", O.with_ctes([EV_LOST, INV, RUNS], f"""
SELECT run_id, agent_type, started_at,
       CAST(epoch_us(TIMESTAMP '{NOW}') - epoch_us(CAST(replace(started_at, '+00:00', '') AS TIMESTAMP)) AS DOUBLE)
         / 1e6 AS elapsed_s
FROM runs WHERE status = 'running'"""), "ST-4 ST-5")
def q_live_runs_lost_ends(spark, sf_dir):
    ev = B.telemetry_events(spark, sf_dir).where("NOT (type = 'run_end' AND run_id LIKE '%7')")
    return R.live_runs(R.runs_table(R.parse_events(ev)), F.lit(NOW + "+00:00").cast("timestamp"))
