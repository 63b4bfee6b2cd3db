"""Run-log triage from files: log parsing rules, manifests, model SQL lookup, failure records."""

import json
import os

from pyspark.sql import functions as F

from runscope.operators import triage as T
from runscope.sources.files import read_log_files, read_manifests, read_model_files


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def _fixture(root):
    logs = os.path.join(root, "runs")
    lines_a = [
        "Running with dbt=1.7.0",                                   # plain text: skipped
        "",                                                         # blank: skipped
        json.dumps({"info": {"level": "info", "msg": "start", "ts": "t0"}}),  # no node, info: dropped
        json.dumps({"info": {"level": "error", "msg": "Database Error in fct_bet", "ts": "t1"},
                    "data": {"node_info": {"unique_id": "model.betting.fct_bet"}}}),
        json.dumps({"info": {"level": "warn", "msg": "deprecated", "ts": "t2"}}),
        # empty top-level data falls through to info.data
        json.dumps({"info": {"level": "debug", "msg": "node seen", "ts": "t3",
                             "data": {"node_info": {"unique_id": "model.betting.dim_user"}}}, "data": {}}),
        # non-empty top-level data without node_info does not fall through
        json.dumps({"info": {"level": "info", "msg": "other", "ts": "t4",
                             "data": {"node_info": {"unique_id": "model.betting.hidden"}}}, "data": {"x": 1}}),
        json.dumps({"info": {"level": "ERROR", "msg": "Compilation Error in ghost", "ts": "t5"},
                    "data": {"node_info": {"unique_id": "model.betting.ghost"}}}),
        json.dumps({"info": {"level": "error", "msg": "Database Error in fct_bet", "ts": "t6"},
                    "data": {"node_info": {"unique_id": "model.betting.fct_bet"}}}),
    ]
    _write(os.path.join(logs, "run_a.log"), "\n".join(lines_a) + "\n")
    _write(os.path.join(logs, "run_b.log"), json.dumps({"info": {"level": "info", "msg": "ok", "ts": "t"}}) + "\n")
    _write(os.path.join(logs, "run_c.log"), json.dumps({"info": {"level": "error", "msg": "boom", "ts": "t"}}) + "\n")
    for rid, code, at in [("run_a", 1, "2026-03-28T16:34:21Z"), ("run_b", 0, "2026-03-28T17:00:00Z"),
                          ("run_c", 2, "2026-03-28T16:00:00Z")]:
        _write(os.path.join(logs, f"{rid}.manifest.json"), json.dumps(
            {"run_id": rid, "command": "dbt build", "exit_code": code, "log_file": f"{rid}.log",
             "started_at": at, "success": code == 0}, indent=2))
    models = os.path.join(root, "models")
    _write(os.path.join(models, "conformed", "fct_bet.sql"), "select 1 as bet_id")
    _write(os.path.join(models, "z_copy", "fct_bet.sql"), "select 2 as bet_id")
    _write(os.path.join(models, "conformed", "dim_user.sql"), "select 1 as user_id")
    return logs, models


def test_log_entries_rules(spark, tmpdir_path):
    logs, _ = _fixture(tmpdir_path)
    e = T.log_entries(read_log_files(spark, logs)).filter("run_id = 'run_a'").orderBy("line_no").collect()
    got = [(r.level, r.message, r.node_id) for r in e]
    assert got == [
        ("ERROR", "Database Error in fct_bet", "model.betting.fct_bet"),
        ("WARN", "deprecated", ""),
        ("DEBUG", "node seen", "model.betting.dim_user"),
        ("ERROR", "Compilation Error in ghost", "model.betting.ghost"),
        ("ERROR", "Database Error in fct_bet", "model.betting.fct_bet"),
    ]


def test_failure_context_and_records(spark, tmpdir_path):
    logs, models = _fixture(tmpdir_path)
    entries = T.log_entries(read_log_files(spark, logs))
    man = read_manifests(spark, logs)
    sql = T.model_sql(read_model_files(spark, models))
    ctx = {r.run_id: r for r in T.failure_context(man, entries, sql).collect()}
    assert set(ctx) == {"run_a", "run_c"}  # run_b succeeded
    a = ctx["run_a"]
    assert a.failed_models == ["fct_bet", "ghost"]
    assert a.error_messages == ["Database Error in fct_bet", "Compilation Error in ghost"]
    assert a.sql_snippets == ["select 1 as bet_id"]  # first file in path order
    assert a.missing_models == ["ghost"]
    c = ctx["run_c"]
    assert c.failed_models == [] and c.error_messages == ["boom"]
    rec = T.failure_records(T.failure_context(man, entries, sql), F.lit("t"), F.lit("high"), F.lit("s"),
                            F.lit("xl")).filter("run_id = 'run_c'").first()
    assert rec.priority == 2 and rec.estimate == 8
    assert "- _(none identified)_" in rec.description and "_(no SQL captured)_" in rec.description
    assert rec.description.endswith("| Started At | `2026-03-28T16:00:00Z` |")


def test_latest_run(spark, tmpdir_path):
    logs, _ = _fixture(tmpdir_path)
    man = read_manifests(spark, logs)
    assert T.latest_run(man, failed_only=False).first().run_id == "run_b"
    assert T.latest_run(man).count() == 0  # newest run succeeded: nothing to triage
    assert T.latest_run(man.filter("run_id <> 'run_b'")).first().run_id == "run_a"


def test_unknown_severity_has_no_priority(spark):
    df = spark.createDataFrame([("bogus", "XXL")], "s string, z string")
    from runscope.functions.columns import estimate_of, priority_of
    r = df.select(priority_of("s").alias("p"), estimate_of("z").alias("e")).first()
    assert r.p is None and r.e is None


def test_found_record_equals_the_rendered_search(spark):
    from runscope.plans import queries_triage as QT
    from tests.conftest import SF_SMALL

    ctx = QT.context(spark, SF_SMALL)
    inputs = QT.severity_inputs(ctx)
    records = T.failure_records(ctx, *inputs).persist()
    title, sev, summary, size = inputs
    for text in ("run_7", "run_1", "t_3", "invalid", "Command", "2024-01", "no such text", "| Field", "dbt build"):
        a = [tuple(r) for r in T.find_record(records, text).collect()]
        b = [tuple(r) for r in T.find_failure_record(ctx, title, sev, summary, size, text).collect()]
        assert a == b, text
