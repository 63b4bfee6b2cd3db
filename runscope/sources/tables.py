"""Sources: driver parquet tables, raw tables with declared schemas, and the source/ref lookup of the layers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.schemas import RAW_DEFAULTS, RAW_SCHEMAS

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
                 "benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. Parquet scan: filters and column pruning reach the reader."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def conform_raw(df: DataFrame, name: str) -> DataFrame:
    """Cast a loaded frame to the declared raw schema and apply the declared column defaults."""
    schema = RAW_SCHEMAS[name]
    defaults = RAW_DEFAULTS.get(name, {})
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]))
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def load_raw(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """IO-1: read a raw table with its declared schema (never inferred)."""
    return conform_raw(spark.read.schema(RAW_SCHEMAS[name]).format(fmt).load(path), name)


class Sources:
    """IO-2 / IO-3: name -> DataFrame lookup for ``source('raw', t)`` and ``ref(model)``.

    Frames can be registered directly (tests, bindings) or fall back to catalog tables ``<schema>.<name>``.
    """

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.frames = dict(frames or {})

    def register(self, key: str, df: DataFrame) -> None:
        self.frames[key] = df

    def source(self, schema: str, name: str) -> DataFrame:
        key = f"{schema}.{name}"
        if key in self.frames:
            return self.frames[key]
        return self.spark.table(key)

    def ref(self, model: str) -> DataFrame:
        if model in self.frames:
            return self.frames[model]
        raise KeyError(f"model {model!r} has not been built")
