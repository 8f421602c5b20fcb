"""Block aggregation of cells and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.grid import Grid, int_div

TILE = ("tile_r", "tile_c")


def with_tile(df: DataFrame, tile: int) -> DataFrame:
    """Add the square tile a cell belongs to."""
    return df.withColumns({"tile_r": int_div("r", tile), "tile_c": int_div("c", tile)})


def block_keys(factor: int) -> dict[str, Column]:
    return {"br": int_div("r", factor), "bc": int_div("c", factor)}


def _group(df: DataFrame, factor: int) -> tuple[DataFrame, list[str]]:
    """Block columns; tile columns are kept among the keys, so that rows already hashed by
    tile stay where they are."""
    within = [t for t in TILE if t in df.columns]
    return df.withColumns(block_keys(factor)), [*within, "br", "bc"]


def block_aggregate(df: DataFrame, factor: int, aggregates: Mapping[str, Column]) -> DataFrame:
    """One row per block. With tile columns present the tile must be a multiple of ``factor``."""
    df, keys = _group(df, factor)
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()]).drop(*TILE)


def block_mean(df: DataFrame, factor: int, values: Sequence[str]) -> DataFrame:
    """NULL-skipping mean of each layer over ``factor x factor`` cells."""
    return block_aggregate(df, factor, {v: F.avg(F.col(v).cast("double")) for v in values})


def binary_median(v: Column, over=None) -> Column:
    """Median of 0/1 values out of two counts: 1, 0, or 0.5 when they tie."""
    ones, n = F.sum(v), F.count(v)
    if over is not None:
        ones, n = ones.over(over), n.over(over)
    return F.when(2 * ones > n, 1.0).when(2 * ones == n, F.when(n > 0, 0.5)).when(n > 0, 0.0)


def block_median(df: DataFrame, factor: int, value: str, binary: bool = False) -> DataFrame:
    """Block median; 0/1 layers combine before the shuffle, others hold one block at a time."""
    agg = binary_median(F.col(value)) if binary else F.median(value)
    return block_aggregate(df, factor, {value: agg})


def block_median_spread(df: DataFrame, factor: int, value: str, name: str, binary: bool = False) -> DataFrame:
    """Give every cell the median of its block (aggregate and disaggregate in one shuffle)."""
    df, keys = _group(df, factor)
    w = Window.partitionBy(*keys)
    med = binary_median(F.col(value), over=w) if binary else F.median(value).over(w)
    return df.withColumn(name, med).drop("br", "bc")


def fill_from_block(df: DataFrame, factor: int, value: str, name: str, binary: bool = True) -> DataFrame:
    """Cell value, or the median of its block where the cell has none."""
    df = block_median_spread(df, factor, value, "_block", binary)
    return df.withColumn(name, F.coalesce(F.col(value), F.col("_block"))).drop("_block")


def complete_blocks(df: DataFrame, grid: Grid, factor: int) -> DataFrame:
    """``df`` (one row a cell at most) with a row for every cell inside the grid of each block that has any row; cells
    without a row of their own get NULL layers.

    A block's rows, ``factor * factor`` at most, meet once and spell out its cells; the domain is not generated or joined,
    so blocks without data cost nothing."""
    layers = [c for c in df.columns if c not in ("r", "c")]
    rows = F.collect_list(F.struct("r", "c", *layers)).alias("_rows")
    blocks = df.withColumns(block_keys(factor)).groupBy("br", "bc").agg(rows)

    def span(block: str, size: int) -> Column:
        first = F.col(block) * factor
        return F.explode(F.sequence(first, F.least(first + (factor - 1), F.lit(size - 1).cast("bigint"))))

    cells = blocks.withColumn("r", span("br", grid.nrow)).withColumn("c", span("bc", grid.ncol))
    own = F.get(F.filter("_rows", lambda x: (x["r"] == F.col("r")) & (x["c"] == F.col("c"))), 0)
    return cells.withColumn("_own", own).select("r", "c", *[F.col(f"_own.{n}").alias(n) for n in layers])


def disaggregate(blocks: DataFrame, domain: DataFrame, factor: int) -> DataFrame:
    """Nearest-neighbour disaggregation of a block table onto the cells of a domain."""
    return domain.withColumns(block_keys(factor)).join(blocks, ["br", "bc"], "left").drop("br", "bc")
