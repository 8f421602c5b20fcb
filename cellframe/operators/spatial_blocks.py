"""Square spatial blocks and block-wise train/test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.binning import step_index
from cellframe.operators.sampling import cut_hash, hash_order
from cellframe.spark import lookup_join


def _extent(df: DataFrame, x: str, y: str) -> Column:
    return df.agg(
        F.struct(
            F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")
        ).alias("s")
    ).scalar()


def _label(k: str, lo: Column, size: float) -> Column:
    """Text of block ``k``; cells on the low edge or past the last break share ``NA``."""
    edge = F.format_string("(%.2f,%.2f]", lo + (F.col(k) - 1) * F.lit(float(size)), lo + F.col(k) * F.lit(float(size)))
    return F.when(F.col(k) == 0, F.lit("NA")).otherwise(edge)


def block_numbers(places: DataFrame, extent: Column, size: float) -> DataFrame:
    """(_kx, _ky, x_grid, y_grid, grid_id): the blocks that occur, labelled and numbered
    from 1 in text order.

    Numbered within each x label first and offset by the labels before it, so only the
    per-label totals (one per block column of the map) meet in one place."""
    blocks = places.select("_kx", "_ky").distinct().withColumn("_s", extent)
    blocks = blocks.select(
        "_kx",
        "_ky",
        _label("_kx", F.col("_s.x0"), size).alias("x_grid"),
        _label("_ky", F.col("_s.y0"), size).alias("y_grid"),
    )
    inner = blocks.withColumn("_k", F.row_number().over(Window.partitionBy("x_grid").orderBy("y_grid")))
    sizes = blocks.groupBy("x_grid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "x_grid",
        (F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("x_grid")) - F.col("_n")).alias("_before"),
    )
    return inner.join(offsets, "x_grid").select(
        "_kx", "_ky", "x_grid", "y_grid", (F.col("_k") + F.col("_before")).alias("grid_id")
    )


def with_block_ids(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Add x_grid, y_grid and grid_id of blocks ``size`` wide, counted from the smallest
    coordinates of the frame itself.

    Rows only get two small integers; labels are made per block."""
    extent = _extent(df, x, y)
    placed = df.withColumn("_s", extent)
    for axis, v in (("x", x), ("y", y)):
        k = step_index(F.col(v), F.col(f"_s.{axis}0"), F.col(f"_s.{axis}1"), size)
        placed = placed.withColumn(f"_k{axis}", F.coalesce(k, F.lit(0)))
    placed = placed.drop("_s")
    return lookup_join(placed, block_numbers(placed, extent, size), ["_kx", "_ky"]).drop("_kx", "_ky")


def split_blocks(
    df: DataFrame, fraction: float = 0.8, seed: int | str = 1, block: str = "grid_id"
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by whole blocks: ``floor(fraction * max id)`` ids out of 1..max train.

    Ids that no longer have rows count as well. Membership is a comparison of the block's
    hash with the cut hash, so neither side is joined."""
    top = df.agg(F.max(block)).first()[0] or 0
    ids = df.sparkSession.range(1, top + 1)
    cut = cut_hash(ids, "id", F.floor(F.lit(float(fraction)) * F.col("_n")), seed).agg(F.max("_cut")).scalar()
    in_train = F.coalesce(hash_order(block, seed) <= cut, F.lit(False))
    return df.filter(in_train), df.filter(~in_train)


def complete_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns that exist, rows without gaps."""
    have = [c for c in columns if c in df.columns]
    return df.select(*have).dropna()


def block_lists(ids: DataFrame, train_ids: DataFrame, block: str = "grid_id") -> DataFrame:
    """Set difference of block ids."""
    return ids.select(block).exceptAll(train_ids.select(block))

