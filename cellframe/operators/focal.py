"""Neighbourhood operators: terrain derivatives and bilinear resampling.

Cells are hashed by square tile once, each tile with a halo of one cell, and the
neighbours are then read with lag/lead along rows and columns inside the tile. Only halo
cells travel twice (about 4/tile of them), nothing is multiplied by nine, and a tile has
a fixed largest size, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.grid import Grid, int_div
from cellframe.operators.blocks import TILE
from cellframe.spark import explode_range

DEFAULT_TILE = 250


def with_halo(df: DataFrame, tile: int = DEFAULT_TILE) -> DataFrame:
    """Send each cell to its tile and to the tiles it borders, one shuffle in all."""

    def tiles(v: str) -> Column:
        own, before, after = int_div(v, tile), int_div(F.greatest(F.col(v) - 1, F.lit(0)), tile), int_div(F.col(v) + 1, tile)
        return F.explode(
            F.when(before != own, F.array(before, own))
            .when(after != own, F.array(own, after))
            .otherwise(F.array(own))
        )

    return (
        df.withColumn("tile_r", tiles("r"))
        .withColumn("tile_c", tiles("c"))
        .repartition(*TILE)
    )


def own_cells(df: DataFrame, tile: int) -> DataFrame:
    """Drop the halo copies."""
    return df.filter((F.col("tile_r") == int_div("r", tile)) & (F.col("tile_c") == int_div("c", tile)))


def _beside(window, axis: str, value: Column, step: int) -> Column:
    """Value of the directly adjacent cell, NULL when that cell is absent."""
    at = F.lag if step < 0 else F.lead
    return F.when(at(axis).over(window) == F.col(axis) + step, at(value).over(window))


def add_terrain(df: DataFrame, grid: Grid, elevation: str = "elev", tile: int = DEFAULT_TILE) -> DataFrame:
    """Add ``slope`` (degrees), ``aspect`` (radians clockwise from north, downslope) and
    ``cos_aspect`` by the 8-neighbour weights of Horn (1981).

    All nine cells are needed; flat cells have no aspect. The result stays hashed by
    (tile_r, tile_c), so block operators can follow without another shuffle."""
    z = F.col(elevation)
    across = Window.partitionBy(*TILE, "r").orderBy("c")
    down = Window.partitionBy(*TILE, "c").orderBy("r")
    df = with_halo(df, tile)
    df = df.withColumns({"_w": _beside(across, "c", z, -1), "_e": _beside(across, "c", z, 1)})
    df = df.withColumns(
        {"_dx": F.when(z.isNotNull(), F.col("_e") - F.col("_w")), "_sx": F.col("_w") + 2 * z + F.col("_e")}
    )
    pair = F.struct("_dx", "_sx")
    df = df.withColumns({"_n": _beside(down, "r", pair, -1), "_s": _beside(down, "r", pair, 1)})
    df = own_cells(df, tile)
    east = (F.col("_n._dx") + 2 * F.col("_dx") + F.col("_s._dx")) / F.lit(8 * grid.xres)
    north = (F.col("_n._sx") - F.col("_s._sx")) / F.lit(8 * grid.yres)
    df = df.withColumns({"_p": east, "_q": north}).withColumn("_g", F.sqrt(F.col("_p") ** 2 + F.col("_q") ** 2))
    turn = F.atan2(-F.col("_p"), -F.col("_q"))
    aspect = F.when(turn < 0, turn + F.lit(2.0) * F.pi()).otherwise(turn)
    return df.withColumns(
        {
            "slope": F.degrees(F.atan("_g")),
            "aspect": F.when(F.col("_g") > 0, aspect),
            "cos_aspect": F.when(F.col("_g") > 0, -F.col("_q") / F.col("_g")),
        }
    ).drop("_w", "_e", "_dx", "_sx", "_n", "_s", "_p", "_q", "_g")


def slope_aspect(df: DataFrame, grid: Grid, elevation: str = "elev", tile: int = DEFAULT_TILE) -> DataFrame:
    out = add_terrain(df.select("r", "c", elevation), grid, elevation, tile)
    return out.select("r", "c", "slope", "aspect", "cos_aspect")


def resample_bilinear(df: DataFrame, source: Grid, target: Grid, value: str = "value") -> DataFrame:
    """Bilinear resampling onto another grid.

    Each source cell with a value writes its weight, and its value times that, to the target cells whose centres are less
    than one source cell away; a target is the weighted mean of what it was sent. No neighbour is looked up and the target
    grid is never joined; sums combine before the one shuffle.

    Targets are those with their centre inside the source grid and a value within reach. Where cells are absent, beside
    a gap or in the half cell at the border, the weights present make up the whole, so a plane is exact wherever all
    four neighbours are."""
    v = F.col(value)

    def target_col(c: Column) -> Column:
        return (source.x_of(c) - F.lit(float(target.xmin))) / F.lit(float(target.xres)) - F.lit(0.5)

    def target_row(r: Column) -> Column:
        return (F.lit(float(target.ymax)) - source.y_of(r)) / F.lit(float(target.yres)) - F.lit(0.5)

    df = df.select(F.col("r").alias("_r"), F.col("c").alias("_c"), v.cast("double").alias("_v")).filter("_v is not null")
    r, c = F.col("_r"), F.col("_c")
    rows = F.greatest(F.floor(target_row(r - 1)) + 1, F.lit(0)), F.least(F.ceil(target_row(r + 1)) - 1, F.lit(target.nrow - 1))
    cols = F.greatest(F.floor(target_col(c - 1)) + 1, F.lit(0)), F.least(F.ceil(target_col(c + 1)) - 1, F.lit(target.ncol - 1))
    df = explode_range(df, *rows, "r")
    df = explode_range(df, *cols, "c")
    x, y = target.x_of("c"), target.y_of("r")
    right = F.lit(float(source.xmin + source.ncol * source.xres))
    bottom = F.lit(float(source.ymax - source.nrow * source.yres))
    inside = x.between(F.lit(float(source.xmin)), right) & y.between(bottom, F.lit(float(source.ymax)))
    wx = F.lit(1.0) - F.abs(x - source.x_of("_c")) / F.lit(float(source.xres))
    wy = F.lit(1.0) - F.abs(y - source.y_of("_r")) / F.lit(float(source.yres))
    sent = df.filter(inside).select("r", "c", "_v", (F.greatest(wx, F.lit(0.0)) * F.greatest(wy, F.lit(0.0))).alias("_w")).filter("_w > 0")
    sums = sent.groupBy("r", "c").agg(F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_v")).alias("_s"))
    return sums.select("r", "c", (F.col("_s") / F.col("_w")).alias(value))


def resample_near(df: DataFrame, source: Grid, target: Grid, value: str = "value") -> DataFrame:
    """Nearest-neighbour resampling: each source cell writes the target centres inside it."""
    lo_x = (F.lit(float(source.xmin)) + F.col("_c") * F.lit(float(source.xres)) - F.lit(float(target.xmin))) / F.lit(
        float(target.xres)
    )
    hi_x = lo_x + F.lit(source.xres / target.xres)
    lo_y = (F.lit(float(target.ymax)) - F.lit(float(source.ymax)) + F.col("_r") * F.lit(float(source.yres))) / F.lit(
        float(target.yres)
    )
    hi_y = lo_y + F.lit(source.yres / target.yres)
    half = F.lit(0.5)
    df = df.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(value))
    df = explode_range(
        df, F.greatest(F.ceil(lo_y - half), F.lit(0)), F.least(F.ceil(hi_y - half) - 1, F.lit(target.nrow - 1)), "r"
    )
    df = explode_range(
        df, F.greatest(F.ceil(lo_x - half), F.lit(0)), F.least(F.ceil(hi_x - half) - 1, F.lit(target.ncol - 1)), "c"
    )
    return df.select("r", "c", value)
