"""Outline of the cells that hold a value, as merged straight segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.grid import Grid, int_div
from cellframe.operators.blocks import block_keys


def coarse_footprint(df: DataFrame, factor: int, value: str) -> DataFrame:
    """Blocks (br, bc) with at least one value."""
    return df.filter(F.col(value).isNotNull()).select(*[k.alias(n) for n, k in block_keys(factor).items()]).distinct()


def boundary_edges(blocks: DataFrame) -> DataFrame:
    """Unit edges (axis, line, pos) that belong to exactly one block."""
    br, bc = F.col("br"), F.col("bc")

    def edge(axis, line, pos):
        return F.struct(F.lit(axis).alias("axis"), line.alias("line"), pos.alias("pos"))

    four = F.array(edge("h", br, bc), edge("h", br + 1, bc), edge("v", bc, br), edge("v", bc + 1, br))
    return (
        blocks.select(F.inline(four))
        .groupBy("axis", "line", "pos")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n = 1")
        .drop("n")
    )


def _merge(df: DataFrame, *keys: str) -> DataFrame:
    """Join touching [start, end) pieces inside each key."""
    w = Window.partitionBy(*keys).orderBy("start")
    starts = F.coalesce((F.lag("end").over(w) != F.col("start")).cast("int"), F.lit(1))
    return (
        df.withColumn("_new", starts)
        .withColumn("_run", F.sum("_new").over(w))
        .groupBy(*keys, "_run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_run")
    )


def merge_edges(unit_edges: DataFrame, chunk: int = 4096) -> DataFrame:
    """Collinear touching edges become segments (axis, line, start, end).

    Done within fixed stretches of a line first and across them second, so that one very
    long straight border is not one task's work."""
    pieces = unit_edges.select(
        "axis", "line", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), int_div("pos", chunk).alias("chunk")
    )
    return _merge(_merge(pieces, "axis", "line", "chunk").drop("chunk"), "axis", "line")


def to_coordinates(segments: DataFrame, grid: Grid) -> DataFrame:
    """End points of the segments on the (coarse) grid they were counted in."""
    x0, y0 = F.lit(float(grid.xmin)), F.lit(float(grid.ymax))
    xs, ys = F.lit(float(grid.xres)), F.lit(float(grid.yres))
    flat = F.col("axis") == "h"
    return segments.select(
        "axis",
        F.when(flat, x0 + F.col("start") * xs).otherwise(x0 + F.col("line") * xs).alias("x1"),
        F.when(flat, y0 - F.col("line") * ys).otherwise(y0 - F.col("start") * ys).alias("y1"),
        F.when(flat, x0 + F.col("end") * xs).otherwise(x0 + F.col("line") * xs).alias("x2"),
        F.when(flat, y0 - F.col("line") * ys).otherwise(y0 - F.col("end") * ys).alias("y2"),
    )


def footprint_segments(df: DataFrame, grid: Grid, factor: int, value: str) -> DataFrame:
    """Dissolved outline of the non-NULL coarse cells as coordinate segments."""
    segments = merge_edges(boundary_edges(coarse_footprint(df, factor, value)))
    return to_coordinates(segments, grid.coarsen(factor))


def footprint_summary(df: DataFrame, grid: Grid, factor: int, value: str) -> DataFrame:
    """Area and bounding box of the footprint."""
    g = grid.coarsen(factor)
    x0, y0 = F.lit(float(g.xmin)), F.lit(float(g.ymax))
    return coarse_footprint(df, factor, value).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        (F.count(F.lit(1)) * F.lit(g.cell_area)).alias("area"),
        (x0 + F.min("bc") * F.lit(float(g.xres))).alias("xmin"),
        (x0 + (F.max("bc") + 1) * F.lit(float(g.xres))).alias("xmax"),
        (y0 - (F.max("br") + 1) * F.lit(float(g.yres))).alias("ymin"),
        (y0 - F.min("br") * F.lit(float(g.yres))).alias("ymax"),
    )
