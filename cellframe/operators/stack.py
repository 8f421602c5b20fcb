"""Aligned layer stacks and composites over years."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.text import year_from_name

CELL = ("r", "c")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Append tables by column name; columns a part lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def name_layers(layers: Mapping[str, DataFrame], keys: Sequence[str] = CELL) -> DataFrame:
    """Long table (layer, keys..., value) out of single-layer tables."""
    return union_all(
        [df.select(F.lit(name).alias("layer"), *keys, F.col("value").cast("double")) for name, df in layers.items()]
    )


def to_long(wide: DataFrame, names: Sequence[str], keys: Sequence[str] = CELL) -> DataFrame:
    """Wide stack to (keys..., layer, value)."""
    return wide.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        list(keys), list(names), "layer", "value"
    )


def stack_layers(long: DataFrame, names: Sequence[str], keys: Sequence[str] = CELL) -> DataFrame:
    """Long layers to one row per cell with one column per name: a single shuffle however
    many layers there are."""
    return (
        long.filter(F.col("layer").isin(list(names)))
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("layer") == n, F.col("value"))).alias(n) for n in names])
    )


def align(tables: Sequence[tuple[DataFrame, Sequence[str]]], keys: Sequence[str] = CELL) -> DataFrame:
    """One row per cell out of wide tables with different layers: a single shuffle of one row per table and cell.

    Every table gives its own columns as doubles and NULL for the others'; a cell's rows meet in one ``max`` per column,
    which combines before the shuffle. Nothing is spelled out per layer, so what is shuffled does not carry layer names
    and keys once more for every value."""
    every = [n for _, names in tables for n in names]
    rows = [
        df.select(*keys, *[(F.col(n) if n in names else F.lit(None)).cast("double").alias(n) for n in every]) for df, names in tables
    ]
    return reduce(lambda a, b: a.union(b), rows).groupBy(*keys).agg(*[F.max(n).alias(n) for n in every])


def parse_year(long: DataFrame, layer: Column | None = None) -> DataFrame:
    """Add the year held in the layer name and drop layers that carry none."""
    layer = F.col("layer") if layer is None else layer
    return long.withColumn("year", year_from_name(layer)).filter("year IS NOT NULL")


def years_damaged(yearly: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Number of years a cell was damaged, over yearly 0/1/NULL values."""
    return yearly.groupBy(*keys).agg(F.sum("value").alias("n_years"))


def first_year_damaged(yearly: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """First damage year; year scaling and the minimum over years are one aggregation."""
    return yearly.groupBy(*keys).agg(F.min(F.when(F.col("value") > 0, F.col("year"))).alias("first_year"))


def composite(yearly: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Both composites from one pass."""
    return yearly.groupBy(*keys).agg(
        F.sum("value").alias("n_years"),
        F.min(F.when(F.col("value") > 0, F.col("year"))).alias("first_year"),
    )
