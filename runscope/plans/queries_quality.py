"""Registered queries for part B (data tests, distributions, profiles, invariants)."""

from __future__ import annotations

from runscope.operators import quality as Q
from runscope.plans import oracle as O
from runscope.plans.queries_warehouse import layers
from runscope.plans.registry import register
from runscope.sources import bindings as B
from runscope.sources.tables import read_table


def _lit_list(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def _sql_result(ch: Q.Check) -> str:
    head = f"SELECT '{ch.model}' AS model, '{ch.test}' AS test, '{ch.column}' AS column_name"
    if ch.test == "not_null":
        return f"{head}, CAST(COUNT(*) FILTER (WHERE {ch.column} IS NULL) AS BIGINT) AS failures FROM {ch.model}"
    if ch.test == "unique":
        return (f"{head}, CAST(COUNT(*) AS BIGINT) AS failures FROM (SELECT {ch.column} FROM {ch.model} "
                f"WHERE {ch.column} IS NOT NULL GROUP BY {ch.column} HAVING COUNT(*) > 1)")
    return (f"{head}, CAST(COUNT(*) AS BIGINT) AS failures FROM (SELECT {ch.column} FROM {ch.model} "
            f"WHERE {ch.column} IS NOT NULL AND CAST({ch.column} AS VARCHAR) NOT IN ({_lit_list(ch.values)}) "
            f"GROUP BY {ch.column})")


def _sql_failures(ch: Q.Check) -> str:
    head = f"SELECT '{ch.model}' AS model, '{ch.test}' AS test, '{ch.column}' AS column_name"
    if ch.test == "not_null":
        return (f"{head}, CAST(NULL AS VARCHAR) AS value, COUNT(*) AS n_records FROM {ch.model} "
                f"WHERE {ch.column} IS NULL HAVING COUNT(*) > 0")
    if ch.test == "unique":
        return (f"{head}, CAST({ch.column} AS VARCHAR) AS value, COUNT(*) AS n_records FROM {ch.model} "
                f"WHERE {ch.column} IS NOT NULL GROUP BY {ch.column} HAVING COUNT(*) > 1")
    return (f"{head}, CAST({ch.column} AS VARCHAR) AS value, COUNT(*) AS n_records FROM {ch.model} "
            f"WHERE {ch.column} IS NOT NULL AND CAST({ch.column} AS VARCHAR) NOT IN ({_lit_list(ch.values)}) "
            f"GROUP BY {ch.column}")


def _results_sql(select: str | None = None) -> str:
    parts = [_sql_result(c) for c in Q.DECLARED_CHECKS if not select or c.model == select]
    body = ("SELECT model, test, column_name, failures, CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status "
            "FROM (" + "\nUNION ALL\n".join(parts) + ")")
    return O.with_ctes(O.WAREHOUSE_CTES, body)


@register("dq_results", _results_sql(), "DQ-1 DQ-2 DQ-3 DQ-5")
def q_dq_results(spark, sf_dir):
    return Q.check_results(layers(spark, sf_dir, mart=True))


@register("dq_results_dim_user", _results_sql("dim_user"), "DQ-4")
def q_dq_results_dim_user(spark, sf_dir):
    return Q.check_results(layers(spark, sf_dir), select="dim_user")


@register("dq_failures", O.with_ctes(O.WAREHOUSE_CTES, "\nUNION ALL\n".join(_sql_failures(c) for c in Q.DECLARED_CHECKS)),
          "DQ-1 DQ-2 DQ-3")
def q_dq_failures(spark, sf_dir):
    return Q.check_failures(layers(spark, sf_dir, mart=True))


@register("dq_lineitem_unique", """
SELECT l_orderkey, l_linenumber, COUNT(*) AS n_records FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""", "DQ-2")
def q_dq_lineitem_unique(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return Q.unique_key_violations(li, ["l_orderkey", "l_linenumber"])


DIST_COLS = ["status", "bet_type", "sport", "outcome", "currency_code", "country_code", "is_same_day_settled"]


@register("value_distribution", O.with_ctes(O.WAREHOUSE_CTES, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n_records FROM fct_bet GROUP BY {c}"
    for c in DIST_COLS)), "SE-1")
def q_value_distribution(spark, sf_dir):
    return Q.value_distribution(layers(spark, sf_dir)["fct_bet"], DIST_COLS)


PROFILE_COLS = ["bet_id", "user_id", "country_code", "is_kyc_verified", "is_user_active", "status", "bet_type",
                "sport", "wager_amount", "potential_payout", "settled_amount", "outcome", "odds", "currency_code",
                "placed_at", "settled_at", "gross_gaming_revenue", "is_same_day_settled"]


@register("table_profile", O.with_ctes(O.WAREHOUSE_CTES, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_nulls, "
    f"COUNT(DISTINCT {c}) AS n_distinct FROM fct_bet" for c in PROFILE_COLS)), "SE-2")
def q_table_profile(spark, sf_dir):
    return Q.table_profile(layers(spark, sf_dir)["fct_bet"], PROFILE_COLS)


INVARIANTS_SQL = O.with_ctes([O.RAW_USERS, O.RAW_BETS, O.RAW_TRANSACTIONS], """
SELECT 'bets_user_fk' AS check_name, CAST(COUNT(*) AS BIGINT) AS failures FROM raw_bets b
  WHERE NOT EXISTS (SELECT 1 FROM raw_users u WHERE u.id = b.user_id)
UNION ALL
SELECT 'transactions_user_fk', COUNT(*) FROM raw_transactions t
  WHERE NOT EXISTS (SELECT 1 FROM raw_users u WHERE u.id = t.user_id)
UNION ALL
SELECT 'transactions_bet_fk', COUNT(*) FROM raw_transactions t
  WHERE t.bet_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM raw_bets b WHERE b.id = t.bet_id)
UNION ALL
SELECT 'transactions_bet_id_null_for_bet_types', COUNT(*) FROM raw_transactions
  WHERE bet_id IS NULL AND lower(type) NOT IN ('deposit', 'withdrawal')
UNION ALL
SELECT 'ledger_balance_breaks', COUNT(*) FROM (
  SELECT balance_after, SUM(CAST(amount AS DECIMAL(24,4))) OVER (PARTITION BY user_id ORDER BY processed_at, id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS expected FROM raw_transactions)
  WHERE CAST(balance_after AS DECIMAL(24,4)) <> expected
UNION ALL
SELECT 'won_bet_missing_ledger_rows', CAST(SUM(CASE WHEN COALESCE(n_debit, 0) = 0 THEN 1 ELSE 0 END)
       + SUM(CASE WHEN COALESCE(n_credit, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT)
  FROM (SELECT id FROM raw_bets WHERE lower(status) = 'settled' AND lower(outcome) = 'won') w
  LEFT JOIN (SELECT bet_id, COUNT(*) FILTER (WHERE lower(type) = 'bet') AS n_debit,
                    COUNT(*) FILTER (WHERE lower(type) = 'winnings') AS n_credit
             FROM raw_transactions WHERE bet_id IS NOT NULL GROUP BY bet_id) p ON w.id = p.bet_id
""")


@register("invariants", INVARIANTS_SQL, "IN-1 IN-2 IN-3 IN-4 JO-5")
def q_invariants(spark, sf_dir):
    return Q.invariants(B.raw_users(spark, sf_dir), B.raw_bets(spark, sf_dir), B.raw_transactions(spark, sf_dir))
