"""Registered queries for trace analytics: spans, reasoning blocks, LLM text, timeline, per-run summary.

The oracle side restates the span tree of the conversation traces directly from the turn structure
(every turn is a closed invocation; user turns hold an LLM call and a tool call, assistant turns an LLM call).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runscope.operators import runs as R
from runscope.operators import trace as TR
from runscope.plans import oracle as O
from runscope.plans.queries_runs import EV
from runscope.plans.registry import register
from runscope.sources import bindings as B

NOW = "2024-03-02 00:00:00"
ISO = "'%Y-%m-%dT%H:%M:%S.%f+00:00'"

TURNS = """
turns AS (
  SELECT conv_id, turn, role, text, length(text) AS n, conv_id * 100000 + 10 + turn * 10 AS s,
         1 + coalesce(sum(CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 2 ELSE 0 END)
               OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM conversations
)"""

SPANS = f"""
span0 AS (
  SELECT conv_id, 0 AS idx, CAST(NULL AS BIGINT) AS parent_idx, 0 AS depth, 'run' AS span_type, 'Run: chat' AS name,
         conv_id * 100000 AS start_seq, conv_id * 100000 + 99999 AS end_seq, CAST(99999.0 AS DOUBLE) AS duration_s,
         'success' AS status, CAST(NULL AS VARCHAR) AS tool_use_id, '' AS token_text, '' AS reasoning_text
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, base, 0, 1, 'invocation', 'Invocation: chat', s, s + CASE WHEN role = 'user' THEN 7 ELSE 4 END,
         CASE WHEN role = 'user' THEN 7.0 ELSE 4.0 END, 'success', NULL, '', ''
  FROM turns WHERE role <> 'system'
  UNION ALL
  SELECT conv_id, base + 1, base, 2, 'llm',
         CASE WHEN role = 'user' THEN 'LLM Call (tool_use)' ELSE 'LLM Call (end_turn)' END,
         s + 1, s + CASE WHEN role = 'user' THEN 4 ELSE 3 END, CASE WHEN role = 'user' THEN 3.0 ELSE 2.0 END,
         'success', NULL, text, CASE WHEN role = 'user' THEN text ELSE '' END
  FROM turns WHERE role <> 'system'
  UNION ALL
  SELECT conv_id, base + 2, base, 2, 'tool', 'Tool: lookup', s + 5, s + 6, 1.0,
         CASE WHEN n % 5 = 0 THEN 'error' ELSE 'success' END,
         'tu-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), '', ''
  FROM turns WHERE role = 'user'
),
spans AS (
  SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS run_id, 'n' || CAST(idx AS VARCHAR) AS span_id,
         CASE WHEN parent_idx IS NOT NULL THEN 'n' || CAST(parent_idx AS VARCHAR) END AS parent_id,
         CAST(depth AS INTEGER) AS depth, CAST(idx AS INTEGER) AS preorder, span_type, name,
         CAST(start_seq AS BIGINT) AS start_seq, CAST(end_seq AS BIGINT) AS end_seq,
         strftime(TIMESTAMP '2024-03-01 00:00:00' + to_seconds(CAST(start_seq AS BIGINT)), {ISO}) AS start_time,
         strftime(TIMESTAMP '2024-03-01 00:00:00' + to_seconds(CAST(end_seq AS BIGINT)), {ISO}) AS end_time,
         CAST(duration_s AS DOUBLE) AS duration_s, status, tool_use_id, token_text, reasoning_text
  FROM span0
)"""

TRACE_CTES = [TURNS, SPANS]


def trace_events(spark, sf_dir):
    return B.trace_events(spark, sf_dir)


@register("trace_spans", O.with_ctes(TRACE_CTES, "SELECT * FROM spans"), "TR-1 TR-3 TR-5")
def q_trace_spans(spark, sf_dir):
    return TR.trace_spans(trace_events(spark, sf_dir)).select(*TR.SPAN_COLS)


@register("trace_spans_native", O.with_ctes(TRACE_CTES, "SELECT * FROM spans"), "TR-2 WI-3")
def q_trace_spans_native(spark, sf_dir):
    return TR.trace_spans_native(trace_events(spark, sf_dir)).select(*TR.SPAN_COLS)


@register("trace_spans_hybrid", O.with_ctes(TRACE_CTES, "SELECT * FROM spans"), "TR-1 TR-2")
def q_trace_spans_hybrid(spark, sf_dir):
    return TR.trace_spans_hybrid(trace_events(spark, sf_dir)).select(*TR.SPAN_COLS)


# The stack replay of the telemetry mix, event by event: the open spans are a list, innermost last.
TELEMETRY_SPANS = """
placed AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS pos,
                  CASE WHEN type IN ('tool_start', 'tool_end') THEN CASE WHEN k % 10 = 0 THEN '' ELSE 'tu_' || k END END
                    AS tool FROM ev),
steps AS (
  SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS made, CAST(NULL AS BIGINT) AS closed,
         CAST(NULL AS BIGINT) AS opened, []::STRUCT(id BIGINT, kind VARCHAR, tool VARCHAR, depth INTEGER, root BIGINT)[]
           AS stack FROM ev
  UNION ALL
  SELECT run_id, pos, made + CAST(type LIKE '%_start' AS BIGINT), target, CASE WHEN type LIKE '%_start' THEN made END,
         CASE WHEN type = 'run_start' THEN list_append(stack, {'id': made, 'kind': 'run', 'tool': NULL, 'depth': 0,
                                                               'root': made})
              WHEN type = 'tool_start' THEN list_append(stack, {'id': made, 'kind': 'tool', 'tool': tool,
                'depth': coalesce(stack[-1].depth + 1, 0), 'root': coalesce(stack[-1].root, made)})
              ELSE list_filter(stack, lambda x: target IS NULL OR x.id <> target) END
  FROM (SELECT s.run_id, e.pos, s.made, s.stack, e.type, e.tool,
               CASE e.type
                 WHEN 'tool_end' THEN coalesce(
                   list_max([x.id for x in s.stack if e.tool <> '' AND x.tool = e.tool]),
                   list_max([x.id for x in s.stack if x.kind = 'tool']))
                 WHEN 'run_end' THEN list_max([x.id for x in s.stack if x.kind = 'run']) END AS target
        FROM steps s JOIN placed e ON e.run_id = s.run_id AND e.pos = s.pos + 1)),
opens AS (
  SELECT s.run_id, s.opened AS id, s.stack[-1].depth AS depth, s.stack[-1].root AS root,
         s.stack[-2].id AS below, e.* EXCLUDE (run_id, pos) FROM steps s JOIN placed e USING (run_id, pos)
  WHERE s.opened IS NOT NULL),
ends AS (SELECT s.run_id, s.closed AS id, e.* EXCLUDE (run_id, pos)
         FROM steps s JOIN placed e USING (run_id, pos) WHERE s.closed IS NOT NULL),
telemetry_spans AS (
  SELECT o.run_id, 'n' || o.id AS span_id, CASE WHEN o.type <> 'run_start' THEN 'n' || o.below END AS parent_id,
         CAST(o.depth AS INTEGER) AS depth,
         CAST(row_number() OVER (PARTITION BY o.run_id ORDER BY o.root, o.id) - 1 AS INTEGER) AS preorder,
         CASE WHEN o.type = 'run_start' THEN 'run' ELSE 'tool' END AS span_type,
         CASE WHEN o.type = 'run_start' THEN 'Run: ' || o.agent ELSE 'Tool: tool_' || o.k % 5 END AS name,
         o.seq AS start_seq, e.seq AS end_seq, o.timestamp AS start_time, e.timestamp AS end_time,
         CASE WHEN e.seq IS NULL THEN NULL WHEN e.type = 'run_end' AND e.k % 4 <> 0 THEN e.value
              WHEN e.type = 'tool_end' AND e.k % 3 <> 0 THEN e.value / CAST(10.0 AS DOUBLE)
              ELSE CAST(greatest(0, epoch_us(e.ts) // 1000 - epoch_us(o.ts) // 1000) AS DOUBLE) / CAST(1000 AS DOUBLE) END AS duration_s,
         CASE WHEN e.seq IS NULL THEN 'running' WHEN e.type = 'run_end' THEN
                CASE WHEN e.value >= 100 THEN 'success' ELSE 'error' END
              WHEN e.k % 7 = 0 THEN 'error' ELSE 'success' END AS status,
         o.tool AS tool_use_id, '' AS token_text, '' AS reasoning_text
  FROM opens o LEFT JOIN ends e ON e.run_id = o.run_id AND e.id = o.id
)"""
TELEMETRY_SPANS_SQL = O.with_ctes([EV, TELEMETRY_SPANS], "SELECT * FROM telemetry_spans").replace(
    "WITH", "WITH RECURSIVE", 1)


@register("telemetry_spans_hybrid", TELEMETRY_SPANS_SQL, "TR-1 TR-2")
def q_telemetry_spans_hybrid(spark, sf_dir):
    """The production path on the unordered telemetry mix: disturbed runs are replayed, the rest native."""
    return TR.trace_spans_hybrid(B.telemetry_events(spark, sf_dir)).select(*TR.SPAN_COLS)


@register("telemetry_spans", TELEMETRY_SPANS_SQL, "TR-1")
def q_telemetry_spans(spark, sf_dir):
    """The exact replay on the unordered telemetry mix (unmatched ends, repeated run_start, empty tool ids)."""
    return TR.trace_spans(B.telemetry_events(spark, sf_dir)).select(*TR.SPAN_COLS)


REASONING = f"""
counted AS (
  SELECT *, CAST(sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS invocation_idx
  FROM turns
),
blocks AS (
  SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS run_id,
         'rb_' || CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS VARCHAR) AS block_id,
         s + CASE WHEN role = 'user' THEN 2 ELSE 0 END AS seq, invocation_idx, text,
         strftime(TIMESTAMP '2024-03-01 00:00:00' + to_seconds(CAST(s + CASE WHEN role = 'user' THEN 2 ELSE 0 END
                  AS BIGINT)), {ISO}) AS timestamp
  FROM counted WHERE role IN ('user', 'system')
)"""


@register("reasoning_blocks", O.with_ctes([TURNS, REASONING],
                                          "SELECT run_id, block_id, seq, invocation_idx, text, timestamp FROM blocks"),
          "WI-2 TR-5")
def q_reasoning_blocks(spark, sf_dir):
    return TR.reasoning_blocks(trace_events(spark, sf_dir))


@register("reasoning_summary", O.with_ctes([TURNS, REASONING], """
SELECT run_id, COUNT(*) AS n_blocks, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY seq)
       AS text
FROM blocks GROUP BY run_id"""), "AG-14")
def q_reasoning_summary(spark, sf_dir):
    return TR.reasoning_summary(TR.reasoning_blocks(trace_events(spark, sf_dir)))


@register("llm_text", O.with_ctes(TRACE_CTES, """
SELECT run_id, span_id, name, token_text, length(token_text) AS text_length, reasoning_text
FROM spans WHERE span_type = 'llm'"""), "AG-11 AG-13 TR-5")
def q_llm_text(spark, sf_dir):
    return TR.llm_text(TR.trace_spans_native(trace_events(spark, sf_dir)))


@register("timeline", O.with_ctes(TRACE_CTES, """
SELECT run_id, span_id, depth, preorder, name,
       CAST((start_seq % 100000) * 1000 AS DOUBLE) / CAST(99999000 AS DOUBLE) * 100.0 AS left_pct,
       greatest(CAST((end_seq - start_seq) * 1000 AS DOUBLE) / CAST(99999000 AS DOUBLE) * 100.0, 0.5) AS width_pct
FROM spans"""), "TR-4 AG-12 WI-4")
def q_timeline(spark, sf_dir):
    return TR.timeline(TR.trace_spans_native(trace_events(spark, sf_dir)), F.lit(NOW + "+00:00").cast("timestamp"))


@register("trace_run_summary", O.with_ctes([TURNS, """
last_turn AS (
  SELECT conv_id, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
                          FROM turns WHERE role = 'assistant') WHERE rn = 1
)"""], f"""
SELECT 'conv-' || CAST(c.conv_id AS VARCHAR) AS run_id, 'chat' AS agent_type,
       strftime(TIMESTAMP '2024-03-01 00:00:00' + to_seconds(CAST(c.conv_id * 100000 AS BIGINT)), {ISO}) AS started_at,
       strftime(TIMESTAMP '2024-03-01 00:00:00' + to_seconds(CAST(c.conv_id * 100000 + 99999 AS BIGINT)), {ISO}) AS ended_at,
       1 AS success, CAST(coalesce(l.n, 0) AS BIGINT) AS total_input_tokens,
       CAST(coalesce(l.n % 97, 0) AS BIGINT) AS total_output_tokens, CAST(NULL AS DOUBLE) AS total_duration_s,
       CAST(floor((l.n * 300 + (l.n % 97) * 1500 + 50) / 100) AS DOUBLE) / 1e6 AS estimated_cost_usd,
       'success' AS status, false AS is_live
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN last_turn l USING (conv_id)"""), "TR-6 PR-11")
def q_trace_run_summary(spark, sf_dir):
    runs = R.runs_table(trace_events(spark, sf_dir))
    return runs.withColumn("is_live", F.col("status") == "running")
