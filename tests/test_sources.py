"""Raw table loading with declared schemas and defaults, and the source()/ref() lookup."""

import os

from pyspark.sql import functions as F

from runscope.operators import warehouse as W
from runscope.sources.tables import Sources, load_raw
from tests.fixtures.seed import seed_frames


def test_load_raw_applies_schema_and_defaults(spark, tmpdir_path):
    users, bets, txs = seed_frames(spark)
    path = os.path.join(tmpdir_path, "users")
    # a loader that left currency and status empty: declared defaults fill them
    users.withColumn("currency_code", F.when(F.col("id") == 1, F.lit(None)).otherwise(F.col("currency_code"))) \
         .withColumn("status", F.when(F.col("id") == 2, F.lit(None)).otherwise(F.col("status"))) \
         .write.parquet(path)
    df = load_raw(spark, "users", path)
    assert [f.name for f in df.schema.fields][:3] == ["id", "username", "email"]
    row = {r.id: r for r in df.collect()}
    assert row[1].currency_code == "GBP" and row[2].status == "active"
    assert dict(df.dtypes)["created_at"] == "timestamp_ntz" and dict(df.dtypes)["id"] == "bigint"


def test_source_and_ref_lookup(spark):
    users, bets, txs = seed_frames(spark)
    src = Sources(spark, {"raw.users": users, "raw.bets": bets})
    std = W.std_user(src.source("raw", "users"))
    src.register("std_user", std)
    assert src.ref("std_user").count() == 15
    users.createOrReplaceTempView("users_tmp_view")
    spark.sql("CREATE DATABASE IF NOT EXISTS raw")
    try:
        src.ref("missing")
        raise AssertionError("expected KeyError")
    except KeyError:
        pass


def test_event_lines_are_strict(spark):
    """One JSON object with double quotes, seq, run_id and type, and nothing after it; all else is a dead letter."""
    from runscope.sources.files import parse_event_lines

    good = ['{"seq":1,"run_id":"r","type":"token","data":{"text":"a}"}}', ' {"seq":2,"run_id":"r","type":"x"} ']
    bad = ['{"seq":1,"run_id":"r","type":"x"} trailing', '{"seq":1,"run_id":"r","type":"x"} {"seq":2}',
           '{"seq":1,"run_id":"r","type":"x"},{"seq":1,"run_id":"r","type":"x"}', "{'seq':1,'run_id':'r','type':'x'}",
           '{"run_id":"r","type":"x"}', '{"seq":1,"type":"x"}', '{"seq":1,"run_id":"r"}', "", "null", "[]", "plain"]
    df = spark.createDataFrame([(x,) for x in good + bad], "value string")
    got = {r["raw"]: r["valid"] for r in parse_event_lines(df).collect()}
    assert got == {x: True for x in good} | {x: False for x in bad}


def test_shared_folder_is_required_on_a_cluster():
    import pytest

    from runscope.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        checkpoint_dir(Session())


def test_log_lines_of_many_splits(spark, tmpdir_path):
    """Logs much larger than a split are numbered as if they were read whole; short and empty logs, too."""
    from runscope.sources.files import read_log_files

    texts = {"long": "".join(f"line {i} {'x' * (i * 7 % 90)}\n" for i in range(5000)), "short": "a\n\nb\r\nlast",
             "empty": "", "blank": "\n\n"}
    for name, text in texts.items():
        with open(os.path.join(tmpdir_path, f"{name}.log"), "w", newline="") as f:
            f.write(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        lines = read_log_files(spark, tmpdir_path)
        assert lines.rdd.getNumPartitions() > 10
        got = sorted(tuple(r) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expected = [(name, i, x) for name, text in texts.items()
                for i, x in enumerate(text.removesuffix("\n").split("\n") if text else [])]
    assert got == sorted(expected)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "wholetext" not in plan


def test_newest_manifest_opens_one_file(spark, tmpdir_path):
    from runscope.sources.files import read_newest_manifest, write_text_files

    assert read_newest_manifest(spark, tmpdir_path).collect() == []
    for i, run in enumerate(("b", "c", "a")):
        write_text_files(spark.createDataFrame([(f"{run}.manifest.json", f'{{"run_id": "{run}", "exit_code": {i}}}')],
                                               "path string, value string"), tmpdir_path)
        os.utime(os.path.join(tmpdir_path, f"{run}.manifest.json"), (1_700_000_000 + i, 1_700_000_000 + i))
    newest = read_newest_manifest(spark, tmpdir_path)
    assert [(r["run_id"], r["exit_code"]) for r in newest.collect()] == [("a", 2)]
    assert [os.path.basename(f) for f in newest.inputFiles()] == ["a.manifest.json"]


def test_written_text_files(spark, tmpdir_path):
    from runscope.sources.files import write_text_files

    rows = [(f"d{i % 3}/run.log", i, f"line {i}") for i in range(1000)] + [(None, 0, "x"), ("n.log", 0, None)]
    df = spark.createDataFrame(rows, "path string, at int, value string").repartition(7)
    write_text_files(df, tmpdir_path, "at")
    write_text_files(df, tmpdir_path, "at")  # again: the same files
    for d in range(3):
        assert os.listdir(os.path.join(tmpdir_path, f"d{d}")) == ["run.log"]
        with open(os.path.join(tmpdir_path, f"d{d}", "run.log")) as f:
            assert f.read() == "".join(f"line {i}\n" for i in range(d, 1000, 3))


def test_files_are_listed_by_tasks(spark, tmpdir_path):
    """No file of many is listed on the driver: the names stand in a table; hidden ones and empty texts are passed over."""
    from runscope.sources import files as S

    for i in range(40):
        os.makedirs(os.path.join(tmpdir_path, f"m/d{i % 5} x/p{i}"))
        with open(os.path.join(tmpdir_path, f"m/d{i % 5} x/p{i}/t_{i}.sql"), "w") as f:
            f.write(f"SELECT {i}\n" if i else "")
    for name in ("_hidden.sql", ".dot.sql", "other.txt"):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write("x")
    with open(os.path.join(tmpdir_path, "r 1.manifest.json"), "w") as f:
        f.write('[{"command": "a"}, {"run_id": "q", "exit_code": 2}]')
    with open(os.path.join(tmpdir_path, "r 1.log"), "w") as f:
        f.write("a\nb")
    models = S.read_model_files(spark, tmpdir_path)
    got = {os.path.basename(r["path"]): r["sql"] for r in models.collect()}
    assert got == {f"t_{i}.sql": f"SELECT {i}\n" for i in range(1, 40)}
    logs, manifests = S.read_log_files(spark, tmpdir_path), S.read_manifests(spark, tmpdir_path)
    assert sorted(tuple(r) for r in logs.collect()) == [("r%201", 0, "a"), ("r%201", 1, "b")]
    assert sorted(tuple(r)[:3] for r in manifests.collect()) == [("q", None, 2), ("r%201", "a", None)]
    for df in (models, logs, manifests):
        assert not any(tmpdir_path in f for f in df.inputFiles())
