"""Inspection helpers: table listing, describe, random sample and the ad hoc row cap (IO-12, IO-13, SO-3, SO-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values that must equal the reference: schemas left out of a table listing (compared case-insensitively)
SYSTEM_SCHEMAS = ["INFORMATION_SCHEMA", "LS_INFORMATION_SCHEMA", "PG_CATALOG", "PUBLIC"]
SYSTEM_SCHEMA_PATTERN = "pg_%"
# rows kept by a random sample and by an ad hoc query
SAMPLE_ROWS = 10
MAX_ROWS = 100


def list_tables(spark: SparkSession) -> DataFrame:
    """IO-12 / FI-3: (table_schema, table_name, table_type) over all databases, system schemas excluded, ordered.
    Catalog metadata only: one row per table, no data is read."""
    rows = []
    for db in spark.catalog.listDatabases():
        for t in spark.catalog.listTables(db.name):
            if t.isTemporary:
                continue
            rows.append((db.name, t.name, "VIEW" if t.tableType == "VIEW" else "BASE TABLE"))
    df = spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")
    schema = F.upper("table_schema")
    return (df.filter(~schema.isin(*SYSTEM_SCHEMAS) & ~F.lower("table_schema").like(SYSTEM_SCHEMA_PATTERN))
            .orderBy("table_schema", "table_name"))


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """IO-13: the schema of a table as rows (col_name, data_type, comment)."""
    return spark.sql(f"DESCRIBE TABLE {name}")


def sample_rows(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """SO-3: up to ``n`` random rows. ``ORDER BY rand LIMIT n`` plans as TakeOrderedAndProject: each task keeps
    its own n best rows, so only n rows per task move; seeded for repeatable samples."""
    return df.orderBy(F.rand(seed)).limit(n)


def row_cap(df: DataFrame, n: int = MAX_ROWS) -> DataFrame:
    """SO-4: at most ``n`` rows of an ad hoc query (the limit is pushed into the plan)."""
    return df.limit(n)
