"""The layer results: cytotype, damage composites, traits and the modelling table.

Input is a wide cell table; see each function for the columns it reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions import algebra as A
from cellframe.grid import Grid
from cellframe.operators.blocks import TILE, block_aggregate, complete_blocks, fill_from_block
from cellframe.operators.focal import DEFAULT_TILE, add_terrain

# Thresholds of the layer preparation.
TARGET_COVER = 0  # cover class of interest
UNSHADED = 1  # shade flag of usable cells
CYTOTYPE_THRESHOLD = 0.5  # above: diploid (1), otherwise triploid (0)
CYTOTYPE_NO_DATA = -0.0001  # below: no data
MASK_KEEP = 0.9
HEIGHT_NO_DATA = -100.0
HEIGHT_LOSS = -3.0  # metres; below: damaged
HOST_CODE = 746
FILL_CELLS = 5
MODEL_CELLS = 10

# The layers of the stack, in order.
STACK = [
    "cover_fraction",
    "diploid_fraction",
    "cytotype_filled",
    "damage_survey",
    "damage_lidar",
    "elevation",
    "cos_aspect",
    "slope",
    "trait_n",
    "trait_d13c",
    "trait_cwc",
    "height",
]


def target_mask(cover: Column, shade: Column) -> Column:
    """1 for unshaded cells of the target class, NULL for all others."""
    both = ((cover == TARGET_COVER) & (shade == UNSHADED)).cast("double")
    return A.clamp_below(both, MASK_KEEP)


def cytotype(raw: Column, cover: Column, shade: Column) -> Column:
    """Masked and thresholded cytotype: 0 triploid, 1 diploid, NULL elsewhere."""
    masked = A.keep_where(raw, target_mask(cover, shade))
    return A.above(A.clamp_below(masked, CYTOTYPE_NO_DATA), CYTOTYPE_THRESHOLD)


def height_change(change: Column) -> Column:
    return A.clamp_below(change, HEIGHT_NO_DATA)


def height_damage(change: Column) -> Column:
    """1 where the canopy lost more than three metres, 0 elsewhere, NULL without data."""
    return (height_change(change) < F.lit(HEIGHT_LOSS)).cast("double")


def trait(value: Column, uncertainty: Column, name: str, elevation: Column) -> Column:
    """Quality-controlled trait, kept only where there is elevation."""
    low, high, most = A.TRAIT_LIMITS[name]
    return A.keep_where(A.quality_null(value, uncertainty, low, high, most), elevation)


def cytotype_layers(cells: DataFrame, factor: int = FILL_CELLS, grid: Grid | None = None) -> DataFrame:
    """cells(r, c, cyto_raw, cover, shade) plus ``cytotype`` and ``cytotype_filled``.

    With ``grid``, cells that the table lacks are filled as well, wherever their block has any row."""
    df = cells if grid is None else complete_blocks(cells, grid, factor)
    df = df.withColumn("cytotype", cytotype(F.col("cyto_raw"), F.col("cover"), F.col("shade")))
    return fill_from_block(df, factor, "cytotype", "cytotype_filled")


def layer_stack(cells: DataFrame, grid: Grid, fill_factor: int = FILL_CELLS, tile: int = DEFAULT_TILE) -> DataFrame:
    """The 12-layer stack for every cell of the domain.

    Reads r, c, cyto_raw, cover, shade, first_year, dh, elev, trait_n, trait_n_unc,
    trait_d13c, trait_d13c_unc, cwc, height. Cells are hashed by tile once; terrain, the
    gap fill and any block mean that follows all work inside the tiles."""
    df = add_terrain(cells, grid, "elev", tile)
    df = df.withColumn("cytotype", cytotype(F.col("cyto_raw"), F.col("cover"), F.col("shade")))
    df = fill_from_block(df, fill_factor, "cytotype", "cytotype_filled")
    elev = F.col("elev")
    return df.select(
        *TILE,
        "r",
        "c",
        A.presence(F.col("cytotype")).cast("double").alias("cover_fraction"),
        F.col("cytotype").alias("diploid_fraction"),
        F.col("cytotype_filled"),
        A.presence(A.keep_where(F.col("first_year"), elev)).cast("double").alias("damage_survey"),
        height_damage(F.col("dh")).alias("damage_lidar"),
        elev.cast("double").alias("elevation"),
        "cos_aspect",
        "slope",
        trait(F.col("trait_n"), F.col("trait_n_unc"), "trait_n", elev).alias("trait_n"),
        trait(F.col("trait_d13c"), F.col("trait_d13c_unc"), "trait_d13c", elev).alias("trait_d13c"),
        F.col("cwc").alias("trait_cwc"),
        F.col("height"),
    )


def cell_table(stack: DataFrame, grid: Grid) -> DataFrame:
    """Cells that hold a cytotype, with coordinates (one row per fine cell)."""
    return (
        grid.with_xy(stack.filter(F.col("diploid_fraction").isNotNull()))
        .withColumn("cell_id", grid.cell_id())
        .drop(*TILE, "cytotype_filled")
    )


#: Layers that say whether a cell has something: 1 or 0 in every cell of the grid.
PRESENCE = ("cover_fraction", "damage_survey")


def _cells_inside(block: str, size: int, factor: int) -> Column:
    """Rows or columns of the grid in a block: fewer in the last one."""
    return F.least(F.lit(factor), F.lit(size) - F.col(block) * factor)


def modelling_table(stack: DataFrame, grid: Grid, factor: int = MODEL_CELLS) -> DataFrame:
    """Block means of the stack for the blocks that hold any target cover, with coordinates."""
    coarse = grid.coarsen(factor)
    names = [n for n in STACK if n != "cytotype_filled"]
    aggregates = {n: F.avg(F.col(n).cast("double")) for n in names if n not in PRESENCE}
    # presence is a share of the block's cells inside the grid, whether or not they have a row
    aggregates |= {n: F.sum(F.col(n).cast("double")) for n in PRESENCE}
    inside = _cells_inside("br", grid.nrow, factor) * _cells_inside("bc", grid.ncol, factor)
    means = block_aggregate(stack, factor, aggregates).withColumns({n: F.col(n) / inside for n in PRESENCE}).select("br", "bc", *names)
    out = means.filter(F.col("cover_fraction") > 0).withColumnsRenamed({"br": "r", "bc": "c"})
    return coarse.with_xy(out).withColumn("cell_id", coarse.cell_id())


def damage_by_year(
    first_years: DataFrame, cover: DataFrame, grid: Grid, years: Sequence[int], keys: Sequence[str] = ("r", "c")
) -> DataFrame:
    """Cells first damaged in each year, inside and outside the target cover, among the cells with elevation.

    ``cover`` has the keys, cover and elev. One grouped count for all years; years without damage are listed with zeros."""
    keys = list(keys)
    inside = F.col("cover") == TARGET_COVER
    counts = (
        first_years.join(cover.filter(F.col("elev").isNotNull()).select(*keys, "cover"), keys)
        .groupBy(F.col("first_year").cast("int").alias("year"))
        .agg(F.count_if(inside).alias("in_cover"), F.count_if(~inside).alias("out_cover"))
    )
    spark = first_years.sparkSession
    span = spark.range(min(years), max(years) + 1).select(F.col("id").cast("int").alias("year"))
    zero = F.lit(0).cast("bigint")
    table = span.join(counts, "year", "left").select(
        "year", F.coalesce("in_cover", zero).alias("in_cover"), F.coalesce("out_cover", zero).alias("out_cover")
    )
    return table.unpivot(["year"], ["in_cover", "out_cover"], "variable", "n_cells").withColumn(
        "area_m2", F.col("n_cells") * F.lit(grid.cell_area)
    )


def site_damage(
    sites: DataFrame, composites: DataFrame, heights: DataFrame, grid: Grid, x: str = "x", y: str = "y"
) -> DataFrame:
    """Sites with survey damage (years counted, presence) and height-loss damage of their cell.

    A cell without survey damage counts 0 years; a site outside the grid has no cell, so its count is NULL and its
    presence FALSE."""
    at = sites.withColumns({"r": grid.row_at(y), "c": grid.col_at(x)})
    out = at.join(composites.select("r", "c", "n_years"), ["r", "c"], "left").join(
        heights.select("r", "c", "dh"), ["r", "c"], "left"
    )
    years = F.when(F.col("r").isNotNull() & F.col("c").isNotNull(), F.coalesce(F.col("n_years"), F.lit(0)))
    return out.withColumns(
        {"damage_survey_years": years, "damage_survey": F.coalesce(years > 0, F.lit(False)), "damage_lidar": height_damage(F.col("dh")) == 1.0}
    ).drop("n_years", "dh")
