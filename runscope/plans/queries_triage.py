"""Registered queries for part C (run-log triage) over the log / manifest / model-SQL bindings."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from runscope.operators import triage as T
from runscope.plans import oracle as O
from runscope.plans.registry import register
from runscope.session import scratch_path
from runscope.sources import bindings as B
from runscope.sources import files as S


def context(spark, sf_dir):
    entries = T.log_entries(B.log_lines(spark, sf_dir))
    return T.failure_context(B.manifests(spark, sf_dir), entries, T.model_sql(B.model_files(spark, sf_dir)))


def severity_inputs(ctx):
    """Stand-ins for the model-chosen fields (title, severity, summary, size), derived from the context."""
    nm, ne = F.size("failed_models"), F.size("error_messages")
    title = F.concat(F.lit("Build failure in "), F.col("run_id"))
    sev = (F.when(nm >= 12, "critical").when(nm >= 8, "HIGH").when(nm >= 1, "Medium").otherwise("low"))
    summary = F.concat(F.lit("Run "), F.col("run_id"), F.lit(" failed with exit code "),
                       F.col("exit_code").cast("string"), F.lit("."))
    size = (F.when(ne > 15, "XL").when(ne > 10, "l").when(ne > 5, "M").when(ne > 0, "S").otherwise("xs"))
    return title, sev, summary, size


ENTRIES = """
entries AS (
  SELECT 'run_' || CAST(user_id AS VARCHAR) AS run_id, event_id AS line_no,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' WHEN 'signup' THEN 'DEBUG' ELSE 'INFO' END
           AS level,
         CASE WHEN event_type = 'error'
              THEN 'Database Error in model t_' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR)
                   || ': invalid value ' || CAST(value AS VARCHAR)
              ELSE event_type || ' event ' || CAST(event_id AS VARCHAR) END AS message,
         CASE WHEN event_type IN ('error', 'click')
                THEN 'model.shop.t_' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR)
              WHEN event_type = 'view'
                THEN 'test.shop.not_null_t_' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR)
              ELSE '' END AS node_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp
  FROM events
  WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 <> 0 AND event_type IN ('error', 'view', 'click')
)"""

MANIFESTS = """
manifests AS (
  SELECT 'run_' || CAST(user_id AS VARCHAR) AS run_id, 'dbt build' AS command, (user_id + 1) % 3 AS exit_code,
         'logs/runs/run_' || CAST(user_id AS VARCHAR) || '.log' AS log_file,
         strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS started_at, (user_id + 1) % 3 = 0 AS success
  FROM events GROUP BY user_id
)"""

MODEL_SQL = """
model_sql AS (
  SELECT 't_' || CAST(p_partkey % 150 AS VARCHAR) AS model_name,
         arg_min('SELECT ' || CAST(p_size AS VARCHAR) || ' AS size, ''' || p_type || ''' AS kind FROM ' || p_name,
                 'models/' || lower(replace(p_brand, '#', '_')) || '/p' || CAST(p_partkey AS VARCHAR) || '/t_'
                 || CAST(p_partkey % 150 AS VARCHAR) || '.sql') AS sql
  FROM part GROUP BY 1
)"""

CONTEXT = """
errs AS (
  SELECT run_id, list(message ORDER BY first_line) AS error_messages
  FROM (SELECT run_id, message, min(line_no) AS first_line FROM entries WHERE level = 'ERROR' GROUP BY run_id, message)
  GROUP BY run_id
),
fm AS (
  SELECT DISTINCT run_id, regexp_extract(node_id, '[^.]*$') AS model_name
  FROM entries WHERE level = 'ERROR' AND node_id <> ''
),
per_run AS (
  SELECT run_id, list(model_name ORDER BY model_name) AS failed_models,
         list(sql ORDER BY model_name) FILTER (WHERE sql IS NOT NULL) AS sql_snippets,
         list(model_name ORDER BY model_name) FILTER (WHERE sql IS NULL) AS missing_models
  FROM fm LEFT JOIN model_sql USING (model_name) GROUP BY run_id
),
context AS (
  SELECT m.run_id, m.command, m.exit_code, m.started_at,
         coalesce(p.failed_models, []::VARCHAR[]) AS failed_models,
         coalesce(e.error_messages, []::VARCHAR[]) AS error_messages,
         coalesce(p.sql_snippets, []::VARCHAR[]) AS sql_snippets,
         coalesce(p.missing_models, []::VARCHAR[]) AS missing_models
  FROM manifests m LEFT JOIN errs e USING (run_id) LEFT JOIN per_run p USING (run_id)
  WHERE m.exit_code <> 0
)"""

TRIAGE_CTES = [ENTRIES, MANIFESTS, MODEL_SQL, CONTEXT]


@register("log_entries", O.with_ctes([ENTRIES], "SELECT * FROM entries"), "FT-1 IO-7 FI-1 FI-2")
def q_log_entries(spark, sf_dir):
    return T.log_entries(B.log_lines(spark, sf_dir))


@register("failed_models", O.with_ctes([ENTRIES],
                                       "SELECT DISTINCT run_id, regexp_extract(node_id, '[^.]*$') AS model_name "
                                       "FROM entries WHERE level = 'ERROR' AND node_id <> ''"), "FT-2 PR-13")
def q_failed_models(spark, sf_dir):
    return T.failed_models(T.log_entries(B.log_lines(spark, sf_dir)))


@register("failure_context", O.with_ctes(TRIAGE_CTES, "SELECT * FROM context"), "FT-3 FI-7 JO-3 JO-4 AG-10 IO-8 IO-9")
def q_failure_context(spark, sf_dir):
    return context(spark, sf_dir)


@register("failure_sections", O.with_ctes(TRIAGE_CTES, """
SELECT run_id, section, CAST(place - 1 AS BIGINT) AS place, text FROM (
  SELECT run_id, 'error' AS section, unnest(error_messages) AS text, generate_subscripts(error_messages, 1) AS place
  FROM context
  UNION ALL
  SELECT run_id, 'model', unnest(failed_models), generate_subscripts(failed_models, 1) FROM context
  UNION ALL
  SELECT run_id, 'sql', unnest(sql_snippets), generate_subscripts(sql_snippets, 1) FROM context
  UNION ALL
  SELECT run_id, 'missing', unnest(missing_models), generate_subscripts(missing_models, 1) FROM context)"""),
          "FT-3 AG-10")
def q_failure_sections(spark, sf_dir):
    entries = T.log_entries(B.log_lines(spark, sf_dir))
    return T.failure_sections(B.manifests(spark, sf_dir), entries, T.model_sql(B.model_files(spark, sf_dir)))


RECORDS_SQL = O.with_ctes(TRIAGE_CTES + ["""
inputs AS (
  SELECT *, 'Build failure in ' || run_id AS title,
         CASE WHEN len(failed_models) >= 12 THEN 'critical' WHEN len(failed_models) >= 8 THEN 'HIGH'
              WHEN len(failed_models) >= 1 THEN 'Medium' ELSE 'low' END AS severity,
         'Run ' || run_id || ' failed with exit code ' || CAST(exit_code AS VARCHAR) || '.' AS summary,
         CASE WHEN len(error_messages) > 15 THEN 'XL' WHEN len(error_messages) > 10 THEN 'l'
              WHEN len(error_messages) > 5 THEN 'M' WHEN len(error_messages) > 0 THEN 'S' ELSE 'xs' END AS estimate_size
  FROM context
)"""], r"""
SELECT run_id, title, severity,
       CASE upper(severity) WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 END AS priority,
       estimate_size,
       CASE upper(estimate_size) WHEN 'XS' THEN 1 WHEN 'S' THEN 2 WHEN 'M' THEN 3 WHEN 'L' THEN 5 WHEN 'XL' THEN 8 END
         AS estimate,
       failed_models, error_messages, sql_snippets, command, exit_code, started_at,
       '## Summary' || chr(10) || summary || chr(10) || chr(10) || '## Failed Models' || chr(10) ||
       CASE WHEN len(failed_models) > 0
            THEN array_to_string(list_transform(failed_models, lambda x: '- `' || x || '`'), chr(10))
            ELSE '- _(none identified)_' END || chr(10) || chr(10) || '## Error Details' || chr(10) ||
       CASE WHEN len(error_messages) > 0
            THEN array_to_string(list_transform(error_messages, lambda x: '```' || chr(10) || x || chr(10) || '```'), chr(10))
            ELSE '_(no error messages captured)_' END || chr(10) || chr(10) || '## SQL Source' || chr(10) ||
       CASE WHEN len(sql_snippets) > 0
            THEN array_to_string(list_transform(sql_snippets, lambda x: '```sql' || chr(10) || x || chr(10) || '```'), chr(10))
            ELSE '_(no SQL captured)_' END || chr(10) || chr(10) || '## Run Metadata' || chr(10) ||
       '| Field | Value |' || chr(10) || '|-------|-------|' || chr(10) ||
       '| Run ID | `' || run_id || '` |' || chr(10) || '| Command | `' || command || '` |' || chr(10) ||
       '| Exit Code | `' || CAST(exit_code AS VARCHAR) || '` |' || chr(10) ||
       '| Started At | `' || coalesce(started_at, 'unknown') || '` |' AS description
FROM inputs""")


@register("failure_records", RECORDS_SQL, "FT-4 PR-14 PR-15")
def q_failure_records(spark, sf_dir):
    ctx = context(spark, sf_dir)
    title, sev, summary, size = severity_inputs(ctx)
    return T.failure_records(ctx, title, sev, summary, size)


@register("latest_failed_run", O.with_ctes([MANIFESTS], """
SELECT * FROM (SELECT * FROM manifests ORDER BY started_at DESC, run_id DESC LIMIT 1) WHERE exit_code <> 0"""),
          "FT-5 WI-1")
def q_latest_failed_run(spark, sf_dir):
    return T.latest_run(B.manifests(spark, sf_dir))


@register("latest_manifest", O.with_ctes([MANIFESTS], """
SELECT * FROM manifests ORDER BY started_at DESC, run_id DESC LIMIT 1"""), "WI-1")
def q_latest_manifest(spark, sf_dir):
    return T.latest_run(B.manifests(spark, sf_dir), failed_only=False)


# ---- the same inputs as files: written below the shared folder, then read by the file sources -------------------

def write_logs(spark, sf_dir, base) -> str:
    path = os.path.join(base, "logs")
    lines = B.log_lines(spark, sf_dir).select(F.concat("run_id", F.lit(".log")).alias("path"), "line_no", "value")
    S.write_text_files(lines, path, "line_no")
    return path


def write_manifests(spark, sf_dir, base) -> str:
    """One file a run; that of the run which ended last is written after all others, as a build would."""
    path = os.path.join(base, "manifests")
    man = B.manifests(spark, sf_dir)
    newest = T.latest_run(man, failed_only=False)
    for part in (man.join(newest, "run_id", "left_anti"), newest):
        S.write_text_files(part.select(F.concat("run_id", F.lit(".manifest.json")).alias("path"),
                                       F.to_json(F.struct(*man.columns)).alias("value")), path)
    return path


def write_models(spark, sf_dir, base) -> str:
    path = os.path.join(base, "project")
    S.write_text_files(B.model_files(spark, sf_dir).select("path", F.col("sql").alias("value")), path)
    return path


#: The lines of a log file are numbered from 0 within their run.
FILE_ENTRIES = ENTRIES.strip().replace("entries AS", "by_event AS", 1) + """,
numbered AS (
  SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events
),
entries AS (SELECT by_event.* REPLACE (place AS line_no) FROM by_event JOIN numbered ON event_id = line_no)"""


@register("log_file_entries", O.with_ctes([FILE_ENTRIES], "SELECT * FROM entries"), "IO-7 FT-1")
def q_log_file_entries(spark, sf_dir):
    return T.log_entries(S.read_log_files(spark, write_logs(spark, sf_dir, scratch_path(spark, "log-files"))))


@register("latest_manifest_file", O.with_ctes([MANIFESTS], """
SELECT * FROM manifests ORDER BY started_at DESC, run_id DESC LIMIT 1"""), "IO-8 WI-1")
def q_latest_manifest_file(spark, sf_dir):
    path = write_manifests(spark, sf_dir, scratch_path(spark, "manifest-files"))
    return S.read_newest_manifest(spark, path).drop("modified_at")


@register("model_sql_files", O.with_ctes([MODEL_SQL], "SELECT model_name, sql FROM model_sql"), "IO-9 JO-3")
def q_model_sql_files(spark, sf_dir):
    path = write_models(spark, sf_dir, scratch_path(spark, "model-files"))
    return T.model_sql(S.read_model_files(spark, path)).select("model_name", F.regexp_replace("sql", "\n$", "").alias("sql"))


@register("failure_context_files", O.with_ctes(TRIAGE_CTES, "SELECT * FROM context"), "FT-3 IO-7 IO-8 IO-9")
def q_failure_context_files(spark, sf_dir):
    base = scratch_path(spark, "build-files")
    entries = T.log_entries(S.read_log_files(spark, write_logs(spark, sf_dir, base)))
    man = S.read_manifests(spark, write_manifests(spark, sf_dir, base))
    sql = T.model_sql(S.read_model_files(spark, write_models(spark, sf_dir, base)))
    return T.failure_context(man, entries, sql.withColumn("sql", F.regexp_replace("sql", "\n$", "")))
