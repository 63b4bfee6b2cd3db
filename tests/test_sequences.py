"""The two-level running sum equals a plain window, also with one key holding a third of the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runscope.operators.sequences import running_sums


def test_running_sums_match_window(spark):
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("k"),   # key 0: a third
        F.col("id").alias("seq"), (F.col("id") % 11 - 5).alias("v"))
    got = running_sums(df, ["k"], F.col("seq"), ["seq"], {"s": F.col("v")}, chunk_width=1000)
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("s", F.sum("v").over(w))
    diff = got.select("k", "seq", "s").exceptAll(ref.select("k", "seq", "s"))
    assert got.count() == n and diff.count() == 0


def test_running_last_matches_window(spark):
    from runscope.operators.sequences import running_last
    n = 20000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 53).alias("k"), F.col("id").alias("seq"),
        F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    got = running_last(df, ["k"], F.col("seq"), ["seq"], {"l": F.col("v")}, chunk_width=500)
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("l", F.last("v", ignorenulls=True).over(w))
    assert got.count() == n
    assert got.select("k", "seq", "l").exceptAll(ref.select("k", "seq", "l")).count() == 0


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), (1, 1, 7)], "k int, seq long, v long")
    got = {(r.k, r.seq): r.s for r in running_sums(df, ["k"], F.col("seq"), ["seq"], {"s": F.col("v")}).collect()}
    assert len(got) == 3 and got[(1, 1)] == 7 and got[(None, 1)] is None


def test_running_previous_of_a_hot_key(spark):
    """A third of the rows share one key: the row before each one, also across chunks."""
    from runscope.operators.sequences import running_previous

    rows = [(i, "" if i % 3 == 0 else f"k{i % 40}") for i in range(600)]
    df = spark.createDataFrame(rows, "seq long, id string").repartition(5)
    got = running_previous(df, ["id"], F.col("seq"), ["seq"], F.struct("seq"), "prev", chunk_width=32).collect()
    last, expected = {}, {}
    for seq, k in rows:
        expected[seq] = last.get(k)
        last[k] = seq
    assert {r["seq"]: r["prev"] and r["prev"]["seq"] for r in got} == expected
