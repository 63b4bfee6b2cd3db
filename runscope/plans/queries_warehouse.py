"""Registered queries for part A (warehouse layers) over the driver-table bindings."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.operators import warehouse as W
from runscope.plans import oracle as O
from runscope.plans.registry import register
from runscope.session import scratch_path
from runscope.sources import bindings as B
from runscope.sources.tables import Sources, load_raw


def layers(spark: SparkSession, sf_dir: str, mart: bool = False) -> dict[str, DataFrame]:
    """The models; the mart, for which the bets are counted, only where it is asked for."""
    build = W.build_layers if mart else W.conformed_layers
    return build(B.raw_users(spark, sf_dir), B.raw_bets(spark, sf_dir), B.raw_transactions(spark, sf_dir))


def _layer_sql(name: str) -> str:
    return O.with_ctes(O.WAREHOUSE_CTES, f"SELECT * FROM {name}")


@register("std_user", _layer_sql("std_user"), "IO-1 IO-2 IO-4 PR-1")
def q_std_user(spark, sf_dir):
    return layers(spark, sf_dir)["std_user"]


@register("std_bet", _layer_sql("std_bet"), "IO-1 IO-2 IO-4 PR-2")
def q_std_bet(spark, sf_dir):
    return layers(spark, sf_dir)["std_bet"]


@register("std_transaction", _layer_sql("std_transaction"), "IO-1 IO-4 PR-3")
def q_std_transaction(spark, sf_dir):
    return layers(spark, sf_dir)["std_transaction"]


@register("dim_user", _layer_sql("dim_user"), "IO-3 PR-4 PR-5 PR-6 PR-7")
def q_dim_user(spark, sf_dir):
    return layers(spark, sf_dir)["dim_user"]


@register("fct_bet", _layer_sql("fct_bet"), "IO-3 JO-1 PR-8 PR-9")
def q_fct_bet(spark, sf_dir):
    return layers(spark, sf_dir)["fct_bet"]


@register("mart_bet_daily", _layer_sql("mart_bet_daily"), "IO-5 AG-1 AG-2 AG-3 AG-4 AG-5 AG-6")
def q_mart_bet_daily(spark, sf_dir):
    return layers(spark, sf_dir, mart=True)["mart_bet_daily"]


# ---- the raw layer as written files: loaded with its declared schema, looked up by name ---------------------------

def _source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """IO-1, IO-2: a raw table written below the shared folder, loaded with its declared schema and defaults, and taken
    from the sources by its name."""
    made = {"users": B.raw_users, "bets": B.raw_bets, "transactions": B.raw_transactions}[table]
    path = os.path.join(scratch_path(spark, "raw"), table)
    # The loader leaves out columns that hold the declared default: the source fills them.
    raw = made(spark, sf_dir)
    raw.withColumn("currency_code", F.when(F.upper("currency_code") != "GBP", F.col("currency_code"))).write.parquet(path)
    sources = Sources(spark, {f"raw.{table}": load_raw(spark, table, path)})
    return sources.source("raw", table)


@register("loaded_users", _layer_sql("std_user"), "IO-1 IO-2 PR-1")
def q_loaded_users(spark, sf_dir):
    return W.std_user(_source(spark, sf_dir, "users"))


@register("loaded_bets", _layer_sql("std_bet"), "IO-1 IO-2 PR-2")
def q_loaded_bets(spark, sf_dir):
    return W.std_bet(_source(spark, sf_dir, "bets"))


@register("loaded_transactions", _layer_sql("std_transaction"), "IO-1 IO-2 PR-3")
def q_loaded_transactions(spark, sf_dir):
    return W.std_transaction(_source(spark, sf_dir, "transactions"))
