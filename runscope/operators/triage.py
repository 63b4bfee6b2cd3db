"""Part C: from build logs, run manifests and model SQL to one structured failure record per failed run,
for all failed runs at once (the reference does one run per agent call)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscope.functions.columns import estimate_of, model_name, priority_of
from runscope.operators.sequences import running_sums
from runscope.sources.files import strict_json

_LOG_SCHEMA = ("struct<info:struct<level:string,msg:string,ts:string,data:map<string,string>>,"
               "data:map<string,string>>")


def log_entries(lines: DataFrame) -> DataFrame:
    """FT-1 (IO-7, FI-1, FI-2): (run_id, line_no, value) -> relevant entries
    (run_id, line_no, level, message, node_id, timestamp).

    Blank lines and lines that are not one JSON object are skipped; a line is parsed once. The node payload is ``data`` when it is a non-empty object, else
    ``info.data`` when non-empty, else nothing; the node id is its ``node_info.unique_id`` or ''. Entries are
    kept when the upper-cased level is ERROR or WARN, or when they name a node.
    """
    p = (strict_json(lines, F.col("value"), _LOG_SCHEMA, ["run_id", "line_no"])
         .filter((F.size("found") == 1) & F.col("found")[0].isNotNull())
         .select("run_id", "line_no", F.col("found")[0].alias("j")))
    top, nested = F.col("j.data"), F.col("j.info.data")
    node_obj = (F.when(F.coalesce(F.size(top), F.lit(0)) > 0, top)
                .when(F.coalesce(F.size(nested), F.lit(0)) > 0, nested))
    node_id = F.coalesce(F.get_json_object(node_obj.getItem("node_info"), "$.unique_id"), F.lit(""))
    level = F.upper(F.coalesce(F.col("j.info.level"), F.lit("")))
    out = p.select("run_id", "line_no", level.alias("level"),
                   F.coalesce(F.col("j.info.msg"), F.lit("")).alias("message"), node_id.alias("node_id"),
                   F.coalesce(F.col("j.info.ts"), F.lit("")).alias("timestamp"))
    return out.filter(F.col("level").isin("ERROR", "WARN") | (F.col("node_id") != ""))


def failed_models(entries: DataFrame) -> DataFrame:
    """FT-2: distinct model names (text after the last dot) of node ids on ERROR entries, per run."""
    return (entries.filter((F.col("level") == "ERROR") & (F.col("node_id") != ""))
            .select("run_id", model_name("node_id").alias("model_name")).distinct())


def model_sql(files: DataFrame) -> DataFrame:
    """JO-3 lookup table: model name (file stem) -> SQL of the first file in path order."""
    name = F.regexp_extract(F.col("path"), r"([^/]+)\.sql$", 1)
    return (files.select(name.alias("model_name"), "path", "sql").groupBy("model_name")
            .agg(F.min(F.struct("path", "sql")).alias("f"))
            .select("model_name", F.col("f.path").alias("path"), F.col("f.sql").alias("sql")))


def failure_context(manifests: DataFrame, entries: DataFrame, sql: DataFrame) -> DataFrame:
    """FT-3 (FI-7, JO-3, JO-4, AG-10): one row per failed run (exit_code != 0), also when no model is named.

    failed_models: sorted distinct names; error_messages: distinct ERROR messages in order of first line;
    sql_snippets: SQL of each failed model that has a file, in model-name order; missing_models: the others.
    Entries are reduced to distinct (run, message) and (run, model) before anything is collected; the SQL is joined
    once per (run, model). Joins are on run_id / model name only.
    """
    failed = manifests.filter(F.col("exit_code") != 0)
    # Each ERROR entry gives a message row and a model row, so the log lines are parsed once. Message rows join by
    # a key that no file stem can be, spread over all tasks; one aggregate per run builds every list.
    errors = entries.filter(F.col("level") == "ERROR").select(
        "run_id", "message", "line_no", F.when(F.col("node_id") != "", model_name("node_id")).alias("model_name"))
    no_text = F.lit(None).cast("string")
    red = (errors.select("run_id", F.inline(F.array(
               F.struct(F.col("message").alias("message"), no_text.alias("model_name"), F.col("line_no").alias("line_no")),
               F.struct(no_text.alias("message"), F.col("model_name").alias("model_name"),
                        F.col("line_no").alias("line_no")))))
           .groupBy("run_id", "message", "model_name").agg(F.min("line_no").alias("first_line"))
           .withColumn("_stem", F.coalesce("model_name", F.concat(F.lit("/"), F.xxhash64("run_id", "message").cast("string"))))
           .join(sql.select(F.col("model_name").alias("_stem"), "sql"), "_stem", "left"))
    has_model = F.col("model_name").isNotNull()
    message = F.when(F.col("message").isNotNull(), F.struct("first_line", "message"))
    per_run = (red.groupBy("run_id")
               .agg(F.array_sort(F.collect_list(message)).alias("_msgs"),
                    F.array_sort(F.collect_set("model_name")).alias("failed_models"),
                    F.array_sort(F.collect_set(F.when(F.col("sql").isNotNull(), F.struct("model_name", "sql"))))
                    .alias("_sql"),
                    F.array_sort(F.collect_set(F.when(has_model & F.col("sql").isNull(), F.col("model_name"))))
                    .alias("missing_models"))
               .select("run_id",
                       F.array_distinct(F.transform("_msgs", lambda m: m["message"])).alias("error_messages"),
                       "failed_models", F.transform("_sql", lambda m: m["sql"]).alias("sql_snippets"),
                       "missing_models"))
    empty = F.array().cast("array<string>")
    return (failed.join(per_run, "run_id", "left")
            .select("run_id", "command", "exit_code", "started_at",
                    F.coalesce("failed_models", empty).alias("failed_models"),
                    F.coalesce("error_messages", empty).alias("error_messages"),
                    F.coalesce("sql_snippets", empty).alias("sql_snippets"),
                    F.coalesce("missing_models", empty).alias("missing_models")))


#: Lines of a log that are numbered together.
LINE_CHUNK = 1 << 16


def failure_sections(manifests: DataFrame, entries: DataFrame, sql: DataFrame) -> DataFrame:
    """FT-3 / AG-10 in parts: (run_id, section, place, text) of every failed run, one row for each distinct error
    message, failed model, its SQL, and each model without a file; places from 0 within a section.

    Messages are numbered in the order of their first line by chunked running sums, so a run that has very many of them
    is spread over tasks and never one row. Models are numbered by name: as many as a project has models.
    """
    failed = manifests.filter(F.col("exit_code") != 0).select("run_id")
    errors = entries.filter(F.col("level") == "ERROR").join(failed, "run_id", "left_semi")
    messages = errors.groupBy("run_id", "message").agg(F.min("line_no").alias("line"))
    messages = running_sums(messages, ["run_id"], F.col("line"), ["line", "message"],
                            {"upto": F.lit(1).cast("bigint")}, chunk_width=LINE_CHUNK)
    messages = messages.select("run_id", F.lit("error").alias("section"), (F.col("upto") - 1).alias("place"),
                               F.col("message").alias("text"))
    models = failed_models(errors).join(sql.select("model_name", "sql"), "model_name", "left")
    known = F.col("sql").isNotNull()
    parts = models.select("run_id", "model_name", F.inline(F.array(
        F.struct(F.lit("model").alias("section"), F.col("model_name").alias("text")),
        F.struct(F.when(known, "sql").otherwise("missing").alias("section"),
                 F.coalesce("sql", "model_name").alias("text")))))
    by_name = Window.partitionBy("run_id", "section").orderBy("model_name")
    parts = parts.select("run_id", "section", (F.row_number().over(by_name) - 1).cast("bigint").alias("place"), "text")
    return messages.unionByName(parts)


def _bullets(arr: Column, fmt_open: str, fmt_close: str, placeholder: str) -> Column:
    body = F.array_join(F.transform(arr, lambda x: F.concat(F.lit(fmt_open), x, F.lit(fmt_close))), "\n")
    return F.when(F.size(arr) > 0, body).otherwise(F.lit(placeholder))


# The texts of a record that are in all of them.
_FIXED_TEXT = ("Summary Failed Models Error Details SQL Source Run Metadata Field Value Run ID Command Exit Code "
               "Started At none identified no error messages captured no SQL captured sql unknown -------|-------")


def render_description(summary: Column, models: Column, errors: Column, snippets: Column, run_id: Column,
                       command: Column, exit_code: Column, started_at: Column) -> Column:
    """PR-15: the markdown body of a failure record (sections, bullet lists, fenced blocks, metadata table)."""
    # fixed values that must equal the reference: section titles, placeholders and fences of the record text
    models_block = _bullets(models, "- `", "`", "- _(none identified)_")
    errors_block = _bullets(errors, "```\n", "\n```", "_(no error messages captured)_")
    sql_block = _bullets(snippets, "```sql\n", "\n```", "_(no SQL captured)_")
    return F.concat(
        F.lit("## Summary\n"), summary, F.lit("\n\n## Failed Models\n"), models_block,
        F.lit("\n\n## Error Details\n"), errors_block, F.lit("\n\n## SQL Source\n"), sql_block,
        F.lit("\n\n## Run Metadata\n| Field | Value |\n|-------|-------|\n| Run ID | `"), run_id,
        F.lit("` |\n| Command | `"), command, F.lit("` |\n| Exit Code | `"), exit_code.cast("string"),
        F.lit("` |\n| Started At | `"), F.coalesce(started_at, F.lit("unknown")), F.lit("` |"))


def failure_records(context: DataFrame, title: Column, severity: Column, summary: Column,
                    estimate_size: Column) -> DataFrame:
    """FT-4 (PR-14, PR-15): the record a ticket is made from. Severity, size, title and summary are inputs
    (chosen by a model in the reference); priority and estimate are looked up case-insensitively."""
    c = context.select("*", title.alias("title"), severity.alias("severity"), summary.alias("summary"),
                       estimate_size.alias("estimate_size"))
    return c.select(
        "run_id", "title", "severity", priority_of(F.col("severity")).alias("priority"),
        "estimate_size", estimate_of(F.col("estimate_size")).alias("estimate"),
        "failed_models", "error_messages", "sql_snippets", "command", "exit_code", "started_at",
        render_description(F.col("summary"), F.col("failed_models"), F.col("error_messages"),
                           F.col("sql_snippets"), F.col("run_id"), F.col("command"), F.col("exit_code"),
                           F.col("started_at")).alias("description"))


def latest_run(manifests: DataFrame, order_col: str = "started_at", failed_only: bool = True) -> DataFrame:
    """FT-5 / WI-1: the newest manifest (ties broken by run_id); with ``failed_only`` it is returned only if
    that run failed. A global max_by: each task keeps its own newest row, one row per task meets in the merge."""
    newest = manifests.agg(F.max_by(F.struct(*manifests.columns), F.struct(order_col, "run_id")).alias("m"))
    out = newest.select("m.*")
    return out.filter(F.col("exit_code") != 0) if failed_only else out


def find_record(records: DataFrame, run_id: str) -> DataFrame:
    """FI-8: the first record (by run id) whose description contains the exact run id."""
    return records.filter(F.col("description").contains(run_id)).orderBy("run_id").limit(1)


def find_failure_record(context: DataFrame, title: Column, severity: Column, summary: Column, estimate_size: Column,
                        run_id: str) -> DataFrame:
    """FI-8 without rendering every record: the run is chosen from the parts of the records, and one is rendered.

    A text of word characters, dots and dashes only can't reach over the marks that stand around each part. One that
    holds others, or stands in the titles themselves, is looked for in the rendered records.
    """
    rendered = lambda c: failure_records(c, title, severity, summary, estimate_size)
    if not re.fullmatch(r"[\w.-]+", run_id) or run_id in _FIXED_TEXT:
        return find_record(rendered(context), run_id)
    lists = [F.exists(c, lambda x: x.contains(run_id)) for c in ("failed_models", "error_messages", "sql_snippets")]
    holds = F.coalesce(summary.contains(run_id), F.lit(False))
    for x in lists + [F.coalesce(F.col(c).cast("string").contains(run_id), F.lit(False))
                      for c in ("run_id", "command", "exit_code", "started_at")]:
        holds = holds | x
    return rendered(context.filter(holds).orderBy("run_id").limit(1))
