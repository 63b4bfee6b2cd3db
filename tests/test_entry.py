"""Driver contract: entry() runs on sf0.001, every oracle has a query, columns line up."""

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "total_bets" in df.columns and "unique_bettors" in df.columns


def test_registry_consistency():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 40


def test_every_query_plans_on_small_data(spark):
    qs = E.queries()
    skip = {"runs_stream", "ingest_dead_letters", "live_spans_stream", "pipeline_build_and_test"}
    for name, fn in qs.items():
        if name in skip:
            continue
        df = fn(spark, SF_SMALL)
        assert len(df.columns) > 0, name
        df.limit(1).collect()
