"""Ordered-sequence helpers that stay exact and spread a hot key over many tasks.

A plain ``sum().over(partitionBy(key).orderBy(...))`` sends every row of a key to one task; if one key holds a
third of the data that task holds a third of the data. ``running_sum`` computes the same numbers in two levels:
rows are cut into chunks of a monotone ordering value, chunk totals are pre-aggregated (map-side combine) and
prefix-summed over the small chunk table, and each row adds its chunk offset to a running sum inside its chunk.
Windows then partition by (key, chunk), so no task sees more than one chunk of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def _attach(rows: DataFrame, per_chunk: DataFrame, keys: list[str]) -> DataFrame:
    """Left join each row to its (keys, chunk) entry. The chunk table is unique on (keys, chunk), so every row
    with non-NULL keys finds exactly one entry and no row is ever dropped; rows whose key is NULL have no
    sequence and get NULL. A plan that uses none of the per-chunk columns drops the join (and the chunk
    aggregate) altogether."""
    return rows.join(per_chunk, keys + ["_chunk"], "left")


def running_sums(df: DataFrame, keys: list[str], chunk_of: Column, order_cols: list[str],
                 values: dict[str, Column], chunk_width: int = DAY_MICROS) -> DataFrame:
    """Add one column per ``values`` entry: the sum of that value over rows of the same ``keys`` up to and
    including this row, in ``order_cols`` order. ``chunk_of`` must be non-decreasing in that order (event
    day number, a sequence number). Use exact types (integer/decimal) so the two-level sum equals the
    sequential one."""
    names = list(values)
    tmp = {n: f"_v_{i}" for i, n in enumerate(names)}
    d = df.select("*", *[values[n].alias(tmp[n]) for n in names],
                  F.floor(chunk_of / F.lit(chunk_width)).alias("_chunk"))
    totals = d.groupBy(*keys, "_chunk").agg(*[F.sum(tmp[n]).alias(f"_t_{tmp[n]}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_t_{tmp[n]}").over(before), F.lit(0))
                                               .alias(f"_o_{tmp[n]}") for n in names])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    out = _attach(d, offsets, keys)
    out = out.select("*", *[(F.col(f"_o_{tmp[n]}") + F.sum(tmp[n]).over(inside)).alias(n) for n in names])
    return out.drop("_chunk", *tmp.values(), *[f"_o_{t}" for t in tmp.values()])


def running_sum(df: DataFrame, keys: list[str], chunk_of: Column, order_cols: list[str], value: Column, out: str,
                chunk_width: int = DAY_MICROS) -> DataFrame:
    """Single-column form of ``running_sums``."""
    return running_sums(df, keys, chunk_of, order_cols, {out: value}, chunk_width)


def running_last(df: DataFrame, keys: list[str], chunk_of: Column, order_cols: list[str],
                 values: dict[str, Column], chunk_width: int = DAY_MICROS) -> DataFrame:
    """Add one column per ``values`` entry: the last non-NULL value of it over rows of the same ``keys`` up to
    and including this row, in ``order_cols`` order (a carry-forward / as-of lookup). Same two-level shape as
    ``running_sums``: each chunk's last value is found by a map-side combinable ``max_by``, carried across the
    small chunk table, and a window inside (key, chunk) finishes the job."""
    names = list(values)
    tmp = {n: f"_l_{i}" for i, n in enumerate(names)}
    order = F.struct(*[F.col(c) for c in order_cols])
    d = df.select("*", *[values[n].alias(tmp[n]) for n in names],
                  F.floor(chunk_of / F.lit(chunk_width)).alias("_chunk"))
    lasts = d.groupBy(*keys, "_chunk").agg(*[F.max_by(F.col(tmp[n]), F.when(F.col(tmp[n]).isNotNull(), order))
                                             .alias(f"_c_{tmp[n]}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*keys, "_chunk", *[F.last(f"_c_{tmp[n]}", ignorenulls=True).over(before)
                                              .alias(f"_o_{tmp[n]}") for n in names])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    out = _attach(d, carried, keys)
    out = out.select("*", *[F.coalesce(F.last(tmp[n], ignorenulls=True).over(inside), F.col(f"_o_{tmp[n]}"))
                            .alias(n) for n in names])
    return out.drop("_chunk", *tmp.values(), *[f"_o_{t}" for t in tmp.values()])


def running_previous(df: DataFrame, keys: list[str], chunk_of: Column, order_cols: list[str], value: Column, out: str,
                     chunk_width: int = DAY_MICROS) -> DataFrame:
    """Add ``out``: the value (never NULL) of the row before this one among rows of the same ``keys``, in
    ``order_cols`` order. In two levels like the sums: the first row of a chunk takes the last value of the chunk
    before it, which is found by a map-side combinable ``max_by``. Rows with a NULL key get none across chunks."""
    order = F.struct(*[F.col(c) for c in order_cols])
    d = df.select("*", value.alias("_v"), F.floor(chunk_of / F.lit(chunk_width)).alias("_chunk"))
    lasts = d.groupBy(*keys, "_chunk").agg(F.max_by("_v", order).alias("_last"))
    carried = lasts.select(*keys, "_chunk", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk"))
                           .alias("_carried"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order_cols)
    rows = _attach(d, carried, keys).withColumn(out, F.coalesce(F.lag("_v").over(inside), F.col("_carried")))
    return rows.drop("_v", "_chunk", "_carried")
