"""Warehouse layers, data tests and invariants on the seed fixture (hand-derived expected values)."""

import os
import re
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from runscope.operators import quality as Q
from runscope.operators import warehouse as W
from runscope.plans.pipeline import run_pipeline
from tests.fixtures.seed import seed_frames


def _layers(spark):
    u, b, t = seed_frames(spark)
    return W.build_layers(u, b, t)


def test_dim_user_flags(spark):
    d = _layers(spark)["dim_user"]
    assert d.count() == 15
    assert d.filter("is_kyc_verified").count() == 9
    assert d.filter("is_active").count() == 13
    dev = {r[0]: r[1] for r in d.groupBy("registration_device").count().collect()}
    assert dev == {"mobile": 8, "desktop": 7}


def test_fct_bet_ggr_and_same_day(spark):
    f = _layers(spark)["fct_bet"]
    ggr = {r.bet_id: r.gross_gaming_revenue for r in f.collect()}
    expected = {1: -12.0, 2: -42.5, 3: -17.5, 4: -16.5, 5: -14.0, 6: 15.0, 7: 8.0, 8: 30.0, 9: 10.0, 10: 20.0,
                11: 0.0, 12: None, 13: None, 14: None, 15: None}
    assert ggr == expected
    same = {r.bet_id: r.is_same_day_settled for r in f.collect()}
    assert all(same[i] for i in range(1, 12)) and not any(same[i] for i in range(12, 16))


def test_fct_bet_unmatched_user_keeps_nulls(spark):
    u, b, t = seed_frames(spark)
    layers = W.build_layers(u.filter("id <> 1"), b, t)
    rows = layers["fct_bet"].filter("user_id = 1").collect()
    assert len(rows) == 2 and all(r.country_code is None and r.is_kyc_verified is None for r in rows)


def test_mart_totals(spark):
    m = _layers(spark)["mart_bet_daily"]
    assert m.count() == 15
    tot = m.agg(F.sum("total_wager"), F.sum("total_settled_amount"), F.sum("total_ggr"), F.sum("total_bets")).first()
    assert tot[0] == 213.0 and tot[1] == 189.5 and tot[2] == -19.5 and tot[3] == 15
    open_row = m.filter("open_bets = 1").select("total_ggr", "settled_bets", "winning_bets").collect()
    assert len(open_row) == 4 and all(r.total_ggr is None and r.settled_bets == 0 for r in open_row)


def test_mart_tasks_follow_the_bets(spark, monkeypatch, capsys):
    """More bets, more tasks, whatever the shuffle setting; null keys and users, and rows that come twice, count as ever."""
    monkeypatch.setattr(W, "TASK_BETS", 1, raising=False)
    rows = []
    for i in range(300):
        i = i if i % 7 else 0  # every 7th is the same row
        lost, won = i % 4 == 1, i % 4 == 2
        wager, settled = 1 + i % 8 / 4, None if i % 4 == 0 else 0.0 if lost else 2.5
        rows.append((None if i % 11 == 5 else datetime(2024, 1, 1) + timedelta(hours=i), ["football", None, "tennis"][i % 3],
                     "single", "GBP", None if i % 5 == 0 else f"C{i % 2}", None if i % 6 == 1 else i % 13,
                     "open" if settled is None else "settled", "lost" if lost else "won" if won else None, wager,
                     settled, wager if lost else wager - 2.5 if won else None, None if i % 9 == 0 else 1 + i % 16 / 8))
    fct = spark.createDataFrame(rows, "placed_at timestamp_ntz, sport string, bet_type string, currency_code string, "
                                      "country_code string, user_id long, status string, outcome string, "
                                      "wager_amount double, settled_amount double, gross_gaming_revenue double, odds double")
    groups = defaultdict(list)
    for r in rows:
        groups[(r[0] and r[0].date(), *r[1:5])].append(r[5:])

    def total(bets, at):
        return sum(values) if (values := [b[at] for b in bets if b[at] is not None]) else None

    def metrics(bets):
        odds = [b[6] for b in bets if b[6] is not None]
        return (len(bets), sum(b[1] == "settled" for b in bets), sum(b[1] == "open" for b in bets),
                sum(b[2] == "won" for b in bets), sum(b[2] == "lost" for b in bets), total(bets, 3), total(bets, 4),
                total(bets, 5), sum(odds) / len(odds) if odds else None, len({b[0] for b in bets} - {None}))

    W.build_layers(*seed_frames(spark))["mart_bet_daily"].explain()  # 15 bets
    dealt = re.findall(r"hashpartitioning\(user_id#\w+, (\d+)\), (\w+)", capsys.readouterr().out)
    assert dealt == [("15", "REPARTITION_BY_NUM"), ("15", "ENSURE_REQUIREMENTS")]
    bets = W.deal_bets(fct, len(rows))
    assert bets.rdd.getNumPartitions() == len(rows)
    mart = W.mart_bet_daily(bets)
    assert sorted(map(tuple, mart.collect()), key=str) == sorted((k + metrics(v) for k, v in groups.items()), key=str)


def test_data_tests_on_seed(spark):
    res = Q.check_results(_layers(spark)).collect()
    assert len(res) == 26
    failed = [r for r in res if r.status == "fail"]
    assert len(failed) == 1
    f = failed[0]
    assert (f.model, f.test, f.column_name, f.failures) == ("dim_user", "accepted_values", "registration_device", 1)
    units = Q.check_failures(_layers(spark)).collect()
    assert [(r.value, r.n_records) for r in units] == [("desktop", 7)]


def test_data_tests_for_one_model(spark):
    res = Q.check_results(_layers(spark), select="fct_bet").collect()
    assert {r.model for r in res} == {"fct_bet"} and len(res) == 4


def test_invariants_hold_on_seed(spark):
    u, b, t = seed_frames(spark)
    got = {r.check_name: r.failures for r in Q.invariants(u, b, t).collect()}
    assert all(v == 0 for v in got.values()), got
    assert t.filter("bet_id IS NULL").count() == 14


def test_ledger_break_is_found(spark):
    u, b, t = seed_frames(spark)
    broken = t.withColumn("balance_after", F.when(F.col("id") == 3, F.lit(113.0)).otherwise(F.col("balance_after")))
    got = {r.check_name: r.failures for r in Q.invariants(u, b, broken).collect()}
    assert got["ledger_balance_breaks"] == 1


def test_value_distribution_and_profile(spark):
    f = _layers(spark)["fct_bet"]
    dist = {(r.column_name, r.value): r.n_records for r in Q.value_distribution(f, ["status", "outcome"]).collect()}
    assert dist[("status", "settled")] == 10 and dist[("outcome", None)] == 4
    prof = {r.column_name: r for r in Q.table_profile(f, ["outcome", "bet_id"]).collect()}
    assert (prof["outcome"].n_rows, prof["outcome"].n_nulls, prof["outcome"].n_distinct) == (15, 4, 3)
    assert prof["bet_id"].n_distinct == 15


def test_pipeline_materialises_layers(spark, tmpdir_path):
    u, b, t = seed_frames(spark)
    res = run_pipeline(spark, u, b, t, tmpdir_path)
    assert res.tests.filter("status = 'fail'").count() == 1
    assert spark.table("conformed.fct_bet").count() == 15
    assert spark.table("mart.mart_bet_daily").count() == 15
    assert spark.table("std_user").count() == 15  # view layer
    from runscope.operators.inspect import describe_table, list_tables
    names = {(r.table_schema, r.table_name) for r in list_tables(spark).collect()}
    assert ("conformed", "dim_user") in names and ("mart", "mart_bet_daily") in names
    cols = [r.col_name for r in describe_table(spark, "conformed.fct_bet").collect()]
    assert cols[:2] == ["bet_id", "user_id"]


def test_approx_profile_close_to_exact(spark):
    from tests.conftest import SF_SMALL
    from runscope.sources.tables import read_table
    li = read_table(spark, SF_SMALL, "lineitem")
    cols = ["l_orderkey", "l_partkey", "l_returnflag"]
    exact = {r.column_name: r for r in Q.table_profile(li, cols).collect()}
    approx = {r.column_name: r for r in Q.table_profile(li, cols, approx=True).collect()}
    for c in cols:
        assert approx[c].n_rows == exact[c].n_rows and approx[c].n_nulls == exact[c].n_nulls
        assert abs(approx[c].n_distinct - exact[c].n_distinct) <= 0.1 * exact[c].n_distinct + 1


def test_replaced_tables_are_whole(spark, tmpdir_path):
    """A reader of the old version goes on; a failed build leaves the table as it was; old versions go."""
    import os

    import pytest

    from runscope.plans.pipeline import replace_table, schema_name

    assert (schema_name(" mart "), schema_name(None, "dev")) == ("mart", "dev")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS swap_test LOCATION '{tmpdir_path}/db'")
    folder = os.path.join(tmpdir_path, "t")
    replace_table(spark, "swap_test.t", spark.range(5), folder)
    before = spark.read.parquet(spark.table("swap_test.t").inputFiles()[0].rsplit("/", 1)[0])
    with pytest.raises(Exception):
        replace_table(spark, "swap_test.t", spark.range(9).selectExpr("assert_true(id < 4) AS x", "id").select("id", "x"),
                      folder)
    assert spark.table("swap_test.t").count() == 5
    for n in (7, 8, 9):
        replace_table(spark, "swap_test.t", spark.range(n), folder)
        assert spark.table("swap_test.t").count() == n
        if n == 7:
            assert before.count() == 5  # the replaced version stays until the next build
    assert len([x for x in os.listdir(folder) if x.startswith("v-")]) == 3  # two, and what the failed build left


def test_builds_with_prefixes_keep_apart(spark, tmpdir_path):
    u, b, t = seed_frames(spark)
    run_pipeline(spark, u, b, t, os.path.join(tmpdir_path, "a"), prefix="a_")
    run_pipeline(spark, u.where("id < 6"), b.where("user_id < 6"), t, os.path.join(tmpdir_path, "b"), prefix="b_")
    run_pipeline(spark, u, b, t, os.path.join(tmpdir_path, "a"), prefix="a_")
    assert (spark.table("a_conformed.dim_user").count(), spark.table("b_conformed.dim_user").count()) == (15, 5)
