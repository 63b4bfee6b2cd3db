"""The driver-table bindings: sizes follow their source tables and the planted irregularities are present."""

from pyspark.sql import functions as F

from runscope.sources import bindings as B
from runscope.sources.tables import read_table
from tests.conftest import SF_SMALL


def test_raw_tables_follow_sources(spark):
    cust = read_table(spark, SF_SMALL, "customer").count()
    users = B.raw_users(spark, SF_SMALL)
    assert users.count() == cust
    assert users.filter(F.col("registration_platform").isNull()).count() > 0
    bets = B.raw_bets(spark, SF_SMALL)
    assert bets.count() == read_table(spark, SF_SMALL, "orders").count()
    orphans = bets.join(users, bets.user_id == users.id, "left_anti").count()
    assert orphans > 0  # bets of an unknown user: the left join keeps them with NULL user columns
    assert bets.filter("status = 'Open'").filter(F.col("settled_at").isNotNull()).count() == 0


def test_ledger_has_planted_breaks(spark):
    tx = B.raw_transactions(spark, SF_SMALL)
    n_events = read_table(spark, SF_SMALL, "events").count()
    assert tx.count() == n_events
    assert tx.filter("bet_id IS NULL").count() == tx.filter("lower(type) IN ('deposit', 'withdrawal')").count()


def test_logs_and_events_bindings(spark):
    lines = B.log_lines(spark, SF_SMALL)
    n = read_table(spark, SF_SMALL, "events").count()
    assert lines.count() == n
    assert lines.filter(~F.col("value").startswith("{")).count() == lines.filter("line_no % 97 = 0").count()
    ev = B.telemetry_events(spark, SF_SMALL)
    assert ev.count() == n and ev.select("seq").distinct().count() == n
    tr = B.trace_events(spark, SF_SMALL)
    runs = read_table(spark, SF_SMALL, "conversations").select("conv_id").distinct().count()
    assert tr.filter("type = 'run_start'").count() == runs == tr.filter("type = 'run_end'").count()
    assert tr.select("seq").distinct().count() == tr.count()
