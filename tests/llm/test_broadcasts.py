"""Rows that an explode makes are never broadcast by Spark's own guess, which is the size of the table below."""

import pytest
from pyspark.sql import functions as F

from runscope.llm import common, decontam, line_dedup, simhash, topk
from tests.llm.edge import edge_docs


@pytest.fixture()
def plans(spark, monkeypatch):
    """``plans(module)``: the plans of the tables that the module writes from now on, as first planned."""
    def of(module):
        found, write = [], module.cut

        def noted(df, name):
            found.append(df._jdf.queryExecution().executedPlan().toString())
            return write(df, name)
        monkeypatch.setattr(module, "cut", noted)
        return found
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield of
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exploded_broadcasts(plan):
    """Lines of a plan's explodes that stand below a broadcast."""
    out, under = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        if under is not None and depth <= under:
            under = None
        if under is None and "BroadcastExchange" in line:
            under = depth
        elif under is not None and "Generate" in line:
            out.append(line.strip())
    return out


def test_plans_are_read(spark, plans):
    one = spark.range(3).select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    joined = spark.range(9).join(F.broadcast(one), F.col("i") == F.col("id"))
    assert len(exploded_broadcasts(joined._jdf.queryExecution().executedPlan().toString())) == 1


def test_top_k_sends_no_copies_of_queries_to_the_driver(spark, plans):
    found = plans(topk)
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<float>")
    got = topk.top_k(rows, F.col("vec_id") % 10 == 0, k=2, query_tile=2, shard_tile=4).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(got)] == [
        (0, 1), (0, 2), (10, 39), (10, 38), (20, 39), (20, 38), (30, 39), (30, 38)]
    joins = [p for p in found if "Join" in p]
    assert joins and not any(map(exploded_broadcasts, joins))


@pytest.mark.parametrize("hot", [0, 64])
def test_simhash_sends_no_table_entries_to_the_driver(spark, plans, hot):
    found = plans(simhash)
    nodes = spark.createDataFrame([(i,) for i in (0, 1, 3, 1 << 40, (1 << 40) + 5, -1)], "fp long")
    links = simhash.links(nodes, hot)
    found.append(links._jdf.queryExecution().executedPlan().toString())
    assert len(found) == 2 and all("Join" in p for p in found)
    assert not any(map(exploded_broadcasts, found))


@pytest.mark.parametrize("limit", [common.BROADCAST_BYTES, -1])
def test_decontamination_sends_no_words_of_documents_to_the_driver(spark, plans, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    found, items = plans(decontam), spark.createDataFrame([(2, "lazy dog"), (5, "all to see")], "item_id int, text string")
    got = decontam.drop_contaminated(edge_docs(spark), items).collect()
    assert {1, 2, 10, 11}.isdisjoint(r["doc_id"] for r in got)
    lines = [x for p in found if "Join" in p for x in exploded_broadcasts(p)]
    # The words of items may be, by their count; a document's list of item ids is one row for each document again.
    assert not [x for x in lines if "explode(hit_items" not in x and (limit < 0 or "posexplode(iw" not in x)]


def test_line_dedup_sends_no_segments_to_the_driver(spark, plans):
    found = plans(line_dedup)
    line_dedup.dedup_lines(edge_docs(spark)).collect()
    joins = [x for p in found for x in p.splitlines() if "Join" in x and "segment" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
