"""DQ-5 / IO-4..6: build every model layer by layer and run the data tests, in one call.

Standardised models are views (lazy plans registered as temp views); conformed and mart models are tables,
fully replaced on each run and read back, so each table layer is a pipeline break: downstream plans start
from the written files (short lineage, nothing recomputed if an executor is lost later). Each layer is a
database of its own, named after the layer; a prefix keeps builds apart that run at the same time.

A table is replaced by writing a folder of its own and then moving the table's location to it: a reader sees the old
table or the new one, never a part. The version that was replaced stays until the next build, for those that still
read it.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from runscope.operators import quality as Q
from runscope.operators import warehouse as W
from runscope.session import SharedFolder

# fixed values that must equal the reference: model -> layer, layer -> materialisation
MODEL_LAYER = {"std_user": "standardised", "std_bet": "standardised", "std_transaction": "standardised",
               "dim_user": "conformed", "fct_bet": "conformed", "mart_bet_daily": "mart"}
LAYER_MATERIALIZATION = {"standardised": "view", "conformed": "table", "mart": "table"}


@dataclass
class PipelineResult:
    models: dict[str, DataFrame]
    tests: DataFrame


def schema_name(layer: str | None, target: str = "default") -> str:
    """IO-6: the database of a model: its layer's name as it is, or the target's where a model has no layer."""
    return target if layer is None else layer.strip()


def replace_table(spark: SparkSession, table: str, df: DataFrame, folder: str) -> DataFrame:
    """IO-5: replace a table's rows in one step, and read them. ``folder`` holds its versions.

    The table's location moves to the new version once that is complete. Another schema drops and makes the table
    anew. The version before the replaced one is deleted.
    """
    version = f"v-{uuid.uuid4().hex}"
    path = os.path.join(folder, version)
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    same = spark.catalog.tableExists(table) and [(f.name, f.dataType) for f in spark.table(table).schema] == [
        (f.name, f.dataType) for f in rows.schema]
    if not same:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet LOCATION '{path}' "
                  f"TBLPROPERTIES ('{_VERSION}' = '{version}')")
        return rows
    held = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_VERSION}' = '{version}', "
              f"'{_REPLACED}' = '{held.get(_VERSION, '')}')")
    spark.catalog.refreshTable(table)
    if held.get(_REPLACED):
        SharedFolder(spark, folder).remove(held[_REPLACED])
    return rows


_VERSION, _REPLACED = "runscope.version", "runscope.replaced"


def _materialise(spark: SparkSession, name: str, df: DataFrame, base_path: str, prefix: str) -> DataFrame:
    layer = MODEL_LAYER[name]
    if LAYER_MATERIALIZATION[layer] == "view":
        df.createOrReplaceTempView(prefix + name)
        return df
    database = prefix + schema_name(layer)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{os.path.join(base_path, database)}'")
    return replace_table(spark, f"{database}.{name}", df, os.path.join(base_path, database, name))


def run_pipeline(spark: SparkSession, users: DataFrame, bets: DataFrame, transactions: DataFrame, base_path: str,
                 checks=Q.DECLARED_CHECKS, select: str | None = None, prefix: str = "") -> PipelineResult:
    """Build std_* (views) -> dim_user, fct_bet (tables) -> mart_bet_daily (table), then test every model.

    ``prefix`` stands before the names of databases and views."""
    m: dict[str, DataFrame] = {}
    m["std_user"] = _materialise(spark, "std_user", W.std_user(users), base_path, prefix)
    m["std_bet"] = _materialise(spark, "std_bet", W.std_bet(bets), base_path, prefix)
    m["std_transaction"] = _materialise(spark, "std_transaction", W.std_transaction(transactions), base_path, prefix)
    m["dim_user"] = _materialise(spark, "dim_user", W.dim_user(m["std_user"]), base_path, prefix)
    m["fct_bet"] = _materialise(spark, "fct_bet", W.fct_bet(m["std_bet"], m["dim_user"]), base_path, prefix)
    dealt = W.deal_bets(m["fct_bet"], m["fct_bet"].count())
    m["mart_bet_daily"] = _materialise(spark, "mart_bet_daily", W.mart_bet_daily(dealt), base_path, prefix)
    return PipelineResult(m, Q.check_results(m, checks, select))
