"""Part B: declarative data tests (not_null / unique / accepted_values), value distributions, table profiles and
the declared referential / ledger invariants of the raw tables.

All checks of a model come from one scan of it: the checked columns are unpivoted to (column, value) pairs and
counted with map-side partial aggregation, so a hot value is reduced to one row per task before the shuffle.
All checks of a build are one result frame computed by one action.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.operators.sequences import running_sum


@dataclass(frozen=True)
class Check:
    model: str
    test: str          # not_null | unique | accepted_values
    column: str
    values: tuple = ()


# ---- fixed values that must equal the reference: the declared tests of the warehouse models ---------------
DECLARED_CHECKS = [
    Check("std_user", "unique", "user_id"),
    Check("std_user", "not_null", "user_id"),
    Check("std_user", "not_null", "email"),
    Check("std_user", "accepted_values", "status", ("active", "suspended")),
    Check("std_user", "accepted_values", "kyc_level", ("none", "partial", "full")),
    Check("std_bet", "unique", "bet_id"),
    Check("std_bet", "not_null", "bet_id"),
    Check("std_bet", "not_null", "user_id"),
    Check("std_bet", "accepted_values", "status", ("open", "settled", "void")),
    Check("std_bet", "not_null", "wager_amount"),
    Check("std_transaction", "unique", "transaction_id"),
    Check("std_transaction", "not_null", "transaction_id"),
    Check("std_transaction", "not_null", "user_id"),
    Check("std_transaction", "accepted_values", "transaction_type", ("deposit", "withdrawal", "bet", "winnings", "refund")),
    Check("dim_user", "unique", "user_id"),
    Check("dim_user", "not_null", "user_id"),
    Check("dim_user", "not_null", "is_kyc_verified"),
    Check("dim_user", "not_null", "is_active"),
    Check("dim_user", "accepted_values", "registration_device", ("mobile", "unknown")),
    Check("fct_bet", "unique", "bet_id"),
    Check("fct_bet", "not_null", "bet_id"),
    Check("fct_bet", "not_null", "user_id"),
    Check("fct_bet", "not_null", "wager_amount"),
    Check("mart_bet_daily", "not_null", "bet_date"),
    Check("mart_bet_daily", "not_null", "total_bets"),
    Check("mart_bet_daily", "not_null", "total_wager"),
]
# ------------------------------------------------------------------------------------------------------------

def _checks_frame(spark, checks) -> DataFrame:
    """The declared checks as a small literal table (its size is the number of declared checks)."""
    rows = [(c.model, c.test, c.column, list(c.values)) for c in checks]
    return spark.createDataFrame(rows, "model string, test string, column_name string, accepted array<string>")


def _model_pairs(df: DataFrame, model: str, checks) -> DataFrame:
    """One scan of a model: every checked column unpivoted to (column_name, value) and counted.

    Columns with a unique or accepted_values check keep their values (as text); columns that only need a
    not_null count keep just NULL vs present, so they add one group per column, not one per distinct value.
    The (column, value) aggregate is map-side combined, so a hot value moves as one row per task.
    """
    valued = sorted({c.column for c in checks if c.test != "not_null"})
    flags = sorted({c.column for c in checks if c.test == "not_null"} - set(valued))
    items = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in valued]
    items += [F.struct(F.lit(c).alias("column_name"), F.when(F.col(c).isNotNull(), F.lit("")).alias("value"))
              for c in flags]
    return (df.select(F.inline(F.array(*items)))
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(model).alias("model"), "column_name", "value", "n"))


def _pairs_with_checks(models: dict[str, DataFrame], checks) -> tuple[DataFrame, DataFrame]:
    by_model: dict[str, list[Check]] = {}
    for ch in checks:
        by_model.setdefault(ch.model, []).append(ch)
    pairs = _union([_model_pairs(models[m], m, cs) for m, cs in by_model.items()])
    spark = next(iter(models.values())).sparkSession
    return pairs, _checks_frame(spark, checks)


def _is_failure() -> Column:
    """Per (check, column value, row count): is this value a failing unit of the check?"""
    t, v, n = F.col("test"), F.col("value"), F.col("n")
    return (F.when(t == "not_null", v.isNull())
            .when(t == "unique", v.isNotNull() & (n > 1))
            .otherwise(v.isNotNull() & ~F.array_contains(F.col("accepted"), v)))


def check_failures(models: dict[str, DataFrame], checks=DECLARED_CHECKS, select: str | None = None) -> DataFrame:
    """DQ-1..4: every failing unit of every check (optionally of one selected model): not_null -> the NULL
    rows as one unit; unique -> each duplicated value; accepted_values -> each value outside the list."""
    chosen = [c for c in checks if not select or c.model == select]
    pairs, cf = _pairs_with_checks(models, chosen)
    return (pairs.join(F.broadcast(cf), ["model", "column_name"])
            .filter(_is_failure())
            .select("model", "test", "column_name", "value", F.col("n").alias("n_records")))


def check_results(models: dict[str, DataFrame], checks=DECLARED_CHECKS, select: str | None = None) -> DataFrame:
    """DQ-5: one row per check with the number of failing units and pass/fail, all checks of a model from
    one scan of it."""
    chosen = [c for c in checks if not select or c.model == select]
    pairs, cf = _pairs_with_checks(models, chosen)
    units = (pairs.join(F.broadcast(cf), ["model", "column_name"])
             .groupBy("model", "test", "column_name")
             .agg(F.sum(F.when(_is_failure(), F.when(F.col("test") == "not_null", F.col("n")).otherwise(1))
                        .otherwise(0)).alias("failures")))
    res = cf.select("model", "test", "column_name").join(units, ["model", "test", "column_name"], "left")
    failures = F.coalesce(F.col("failures"), F.lit(0)).cast("bigint")
    return res.select("model", "test", "column_name", failures.alias("failures"),
                      F.when(failures == 0, "pass").otherwise("fail").alias("status"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unique_key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """unique over a composite key: each duplicated key with its row count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"))
            .filter(F.col("n_records") > 1))


# ---- SE: distributions and profiles ------------------------------------------------------------------------

def _stacked(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])))


def value_distribution(df: DataFrame, cols: list[str]) -> DataFrame:
    """SE-1: distinct values and their row counts for each column (NULL is a value)."""
    return (_stacked(df, cols).groupBy("column_name", "value")
            .agg(F.count(F.lit(1)).alias("n_records")))


def table_profile(df: DataFrame, cols: list[str] | None = None, approx: bool = False, rsd: float = 0.05) -> DataFrame:
    """SE-2: rows, NULLs and distinct count per column in one plan.

    Exact: (column, value) pairs are first reduced with their counts, then summed per column -- no N-fold
    Expand of N ``count(DISTINCT)`` aggregates, every stage map-side combinable. ``approx=True`` uses
    HyperLogLog sketches instead: one aggregate, distinct values never shuffled (relative error ``rsd``).
    """
    cols = cols or df.columns
    if approx:
        agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                     *[F.count_if(F.col(c).isNull()).alias(f"_n_{i}") for i, c in enumerate(cols)],
                     *[F.approx_count_distinct(c, rsd).alias(f"_d_{i}") for i, c in enumerate(cols)])
        return agg.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col("_rows").alias("n_rows"),
                     F.col(f"_n_{i}").alias("n_nulls"), F.col(f"_d_{i}").alias("n_distinct"))
            for i, c in enumerate(cols)])))
    pairs = _stacked(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return (pairs.groupBy("column_name")
            .agg(F.sum("n").alias("n_rows"),
                 F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"),
                 F.count("value").alias("n_distinct")))


# ---- IN: declared invariants of the raw tables --------------------------------------------------------------

def invariants(users: DataFrame, bets: DataFrame, transactions: DataFrame) -> DataFrame:
    """IN-1..4 as one (check, failures) table.

    Foreign keys are left-anti joins (AQE broadcasts the key side only when its measured size allows);
    the ledger check is the skew-safe running sum; the won-bet ledger is conditional counts per bet joined
    back to the bets.
    """
    uid = users.select(F.col("id").alias("_uid"))
    bet_orphans = bets.join(uid, bets.user_id == uid._uid, "left_anti").agg(F.count(F.lit(1)).alias("failures"))
    tx_user_orphans = (transactions.join(uid, transactions.user_id == uid._uid, "left_anti")
                       .agg(F.count(F.lit(1)).alias("failures")))
    bid = bets.select(F.col("id").alias("_bid"))
    tx_bet = transactions.filter(F.col("bet_id").isNotNull())
    tx_bet_orphans = (tx_bet.join(bid, tx_bet.bet_id == bid._bid, "left_anti")
                      .agg(F.count(F.lit(1)).alias("failures")))
    null_bet = transactions.agg(F.count_if(F.col("bet_id").isNull() & ~F.lower("type").isin("deposit", "withdrawal"))
                                .alias("failures"))
    led = running_sum(transactions, ["user_id"], F.unix_date(F.to_date("processed_at")),
                      ["processed_at", "id"], F.col("amount").cast("decimal(28,8)"), "_expected", chunk_width=1)
    breaks = led.agg(F.count_if(F.col("balance_after").cast("decimal(28,8)") != F.col("_expected"))
                     .alias("failures"))
    per_bet = (transactions.filter(F.col("bet_id").isNotNull())
               .groupBy("bet_id")
               .agg(F.count_if(F.lower("type") == "bet").alias("n_debit"),
                    F.count_if(F.lower("type") == "winnings").alias("n_credit")))
    won = bets.filter((F.lower("status") == "settled") & (F.lower("outcome") == "won")).select("id")
    won_bad = (won.join(per_bet, won.id == per_bet.bet_id, "left")
               .agg(F.count_if(F.coalesce(F.col("n_debit"), F.lit(0)) == 0)
                    .alias("f1"), F.count_if(F.coalesce(F.col("n_credit"), F.lit(0)) == 0).alias("f2"))
               .select((F.col("f1") + F.col("f2")).alias("failures")))
    parts = [(bet_orphans, "bets_user_fk"), (tx_user_orphans, "transactions_user_fk"),
             (tx_bet_orphans, "transactions_bet_fk"), (null_bet, "transactions_bet_id_null_for_bet_types"),
             (breaks, "ledger_balance_breaks"), (won_bad, "won_bet_missing_ledger_rows")]
    return _union([p.select(F.lit(name).alias("check_name"), F.col("failures").cast("bigint").alias("failures"))
                   for p, name in parts])
