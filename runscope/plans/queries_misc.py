"""Registered queries for the remaining operators: build-and-test pipeline, inspection, payload truncation,
response outcome detection and record lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from runscope.functions.columns import CODE_FIX_FAILURE_MARKERS, TICKET_FAILURE_MARKERS, response_succeeded, \
    truncate_payload
from runscope.operators import inspect as I
from runscope.operators import quality as Q
from runscope.operators import triage as T
from runscope.plans import oracle as O
from runscope.plans.pipeline import run_pipeline
from runscope.plans.queries_quality import _results_sql
from runscope.plans.queries_triage import RECORDS_SQL, context, severity_inputs
from runscope.plans.queries_warehouse import layers
from runscope.plans.registry import register
from runscope.session import scratch_path
from runscope.sources import bindings as B
from runscope.sources.tables import read_table


@register("pipeline_build_and_test", _results_sql(), "DQ-5 IO-4 IO-5 IO-6")
def q_pipeline(spark, sf_dir):
    res = run_pipeline(spark, B.raw_users(spark, sf_dir), B.raw_bets(spark, sf_dir), B.raw_transactions(spark, sf_dir),
                       scratch_path(spark, "warehouse"))
    return res.tests


def _built(spark, sf_dir, prefix):
    return run_pipeline(spark, B.raw_users(spark, sf_dir), B.raw_bets(spark, sf_dir), B.raw_transactions(spark, sf_dir),
                        scratch_path(spark, "warehouse"), select="mart_bet_daily", prefix=prefix)


BUILT = [("conformed", "dim_user"), ("conformed", "fct_bet"), ("mart", "mart_bet_daily")]


@register("built_tables", O.with_ctes(O.WAREHOUSE_CTES, "\nUNION ALL\n".join(
    f"SELECT 'listed_{d}' AS table_schema, '{t}' AS table_name, 'BASE TABLE' AS table_type, COUNT(*) AS n_rows FROM {t}"
    for d, t in BUILT)), "IO-12 FI-3 IO-5 IO-6")
def q_built_tables(spark, sf_dir):
    """The listing of the tables that a build left in the catalog, with their rows."""
    _built(spark, sf_dir, "listed_")
    listed = I.list_tables(spark).where("table_schema LIKE 'listed\\_%'")
    counts = None
    for d, t in BUILT:
        n = spark.table(f"listed_{d}.{t}").agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(f"listed_{d}").alias("table_schema"), F.lit(t).alias("table_name"), "n_rows")
        counts = n if counts is None else counts.union(n)
    return listed.join(counts, ["table_schema", "table_name"], "left")


FCT_TYPES = {"bet_id": "bigint", "user_id": "bigint", "country_code": "string", "is_kyc_verified": "boolean",
             "is_user_active": "boolean", "status": "string", "bet_type": "string", "sport": "string",
             "wager_amount": "double", "potential_payout": "double", "settled_amount": "double", "outcome": "string",
             "odds": "double", "currency_code": "string", "placed_at": "timestamp_ntz", "settled_at": "timestamp_ntz",
             "gross_gaming_revenue": "double", "is_same_day_settled": "boolean"}


@register("described_table", O.with_ctes(O.WAREHOUSE_CTES, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS col_name, '{t}' AS data_type, COUNT({c}) AS n_values FROM fct_bet"
    for c, t in FCT_TYPES.items())), "IO-13")
def q_described_table(spark, sf_dir):
    """Columns and types of a built table, with the number of values of each."""
    _built(spark, sf_dir, "described_")
    table = "described_conformed.fct_bet"
    described = I.describe_table(spark, table)
    values = Q.table_profile(spark.table(table), list(FCT_TYPES)).select(
        F.col("column_name").alias("col_name"), (F.col("n_rows") - F.col("n_nulls")).alias("n_values"))
    return described.join(values, "col_name").select("col_name", "data_type", "n_values")


@register("sample_orders", None, "SO-3")
def q_sample_orders(spark, sf_dir):
    return I.sample_rows(read_table(spark, sf_dir, "orders"), 10, seed=42)


# Far more groups than the cap lets through.
ADHOC = ("SELECT user_id, COUNT(*) AS n_bets FROM fct_bet GROUP BY user_id "
         "ORDER BY n_bets DESC, user_id")


@register("adhoc_query_capped", O.with_ctes(O.WAREHOUSE_CTES, ADHOC + " LIMIT 100"), "SO-4 IO-4")
def q_adhoc_query_capped(spark, sf_dir):
    layers(spark, sf_dir)["fct_bet"].createOrReplaceTempView("fct_bet")
    return I.row_cap(spark.sql(ADHOC), 100)


@register("truncated_payloads", """
SELECT doc_id, length(text) AS n_chars_full,
       CASE WHEN length(text) > 2000
            THEN substr(text, 1, 2000) || '... (' || CAST(length(text) - 2000 AS VARCHAR) || ' chars truncated)'
            ELSE text END AS payload
FROM documents""", "PR-12")
def q_truncated_payloads(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.char_length("text").alias("n_chars_full"), truncate_payload("text").alias("payload"))


def _markers_sql(markers) -> str:
    return "NOT (" + " OR ".join(f"contains(lower(text), '{m}')" for m in markers) + ")"


@register("response_outcomes", f"""
SELECT conv_id, turn, {_markers_sql(TICKET_FAILURE_MARKERS)} AS ticket_success,
       {_markers_sql(CODE_FIX_FAILURE_MARKERS)} AS code_fix_success
FROM conversations WHERE role = 'assistant'""", "PR-16")
def q_response_outcomes(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", response_succeeded("text", "ticket").alias("ticket_success"),
                    response_succeeded("text", "code-fix").alias("code_fix_success"))


@register("find_failure_record", RECORDS_SQL + " WHERE contains(description, 'run_7') ORDER BY run_id LIMIT 1", "FI-8")
def q_find_failure_record(spark, sf_dir):
    ctx = context(spark, sf_dir)
    title, sev, summary, size = severity_inputs(ctx)
    return T.find_failure_record(ctx, title, sev, summary, size, "run_7")
