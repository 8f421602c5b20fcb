"""Survey polygons: vertex tables and rasterization.

A polygon row carries ``rings ARRAY<STRUCT<hole, pts ARRAY<STRUCT<x, y>>>>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.grid import Grid
from cellframe.spark import explode_range

RINGS_DDL = "array<struct<hole: boolean, pts: array<struct<x: double, y: double>>>>"


def parts(polygons: DataFrame) -> DataFrame:
    """One row per ring, numbered from 1."""
    keep = [c for c in polygons.columns if c != "rings"]
    return polygons.select(*keep, F.posexplode("rings").alias("_i", "ring")).select(
        *keep,
        (F.col("_i") + 1).alias("ring_no"),
        F.col("ring.hole").alias("hole"),
        F.col("ring.pts").alias("pts"),
    )


def vertices(polygons: DataFrame) -> DataFrame:
    """One row per vertex: (..., ring_no, hole, vertex_no, x, y)."""
    rings = parts(polygons)
    keep = [c for c in rings.columns if c != "pts"]
    return rings.select(*keep, F.posexplode("pts").alias("_i", "pt")).select(
        *keep, (F.col("_i") + 1).alias("vertex_no"), "pt.x", "pt.y"
    )


def outer_vertices(polygons: DataFrame) -> DataFrame:
    return vertices(polygons).filter(~F.col("hole"))


def hole_vertices(polygons: DataFrame) -> DataFrame:
    return vertices(polygons).filter("hole")


def edges(polygons: DataFrame) -> DataFrame:
    """One row per ring edge; the last vertex is joined to the first."""
    rings = parts(polygons).filter(F.size("pts") >= 3)
    keep = [c for c in rings.columns if c != "pts"]
    nxt = F.concat(F.slice("pts", F.lit(2), F.size("pts") - 1), F.slice("pts", 1, 1))
    pairs = F.explode(F.arrays_zip(F.col("pts").alias("a"), nxt.alias("b")))
    return rings.select(*keep, pairs.alias("e")).select(
        *keep,
        F.col("e.a.x").alias("x1"),
        F.col("e.a.y").alias("y1"),
        F.col("e.b.x").alias("x2"),
        F.col("e.b.y").alias("y2"),
    )


def polygon_cells(polygons: DataFrame, grid: Grid, poly_key: str = "poly_id", keep: Sequence[str] = ()) -> DataFrame:
    """Cells whose centre lies inside each polygon (even-odd rule, holes included).

    Scan lines instead of point tests: an edge yields its crossing with every row centre it
    spans, crossings pair up along a row, and each pair is a run of columns. The work is
    the length of the outlines plus the cells found; neither the layer nor a box of
    candidate cells is joined, and a huge polygon is spread over its rows."""
    keep = list(keep)
    row = (F.lit(float(grid.ymax)) - F.greatest("y1", "y2")) / F.lit(float(grid.yres)) - F.lit(0.5)
    end = (F.lit(float(grid.ymax)) - F.least("y1", "y2")) / F.lit(float(grid.yres)) - F.lit(0.5)
    # the polygon table is small next to its crossings: spread the edges before they multiply
    spans = edges(polygons.select(poly_key, *keep, "rings")).filter("y1 <> y2").repartition(poly_key, "x1", "y1")
    crossings = explode_range(
        spans,
        F.greatest(F.floor(row) + 1, F.lit(0)),
        F.least(F.floor(end), F.lit(grid.nrow - 1)),
        "r",
    ).withColumn(
        "_x",
        F.col("x1") + (grid.y_of("r") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")),
    )
    along = Window.partitionBy(poly_key, *keep, "r").orderBy("_x")
    runs = (
        crossings.select(poly_key, *keep, "r", "_x")
        .withColumns({"_nth": F.row_number().over(along), "_next": F.lead("_x").over(along)})
        .filter("_nth % 2 = 1 AND _next IS NOT NULL")
    )

    def first_col(x: Column) -> Column:
        return F.ceil((x - F.lit(float(grid.xmin))) / F.lit(float(grid.xres)) - F.lit(0.5))

    cells = explode_range(
        runs,
        F.greatest(first_col(F.col("_x")), F.lit(0)),
        F.least(first_col(F.col("_next")) - 1, F.lit(grid.ncol - 1)),
        "c",
    )
    return cells.select(poly_key, *keep, "r", "c")


def rasterize(polygons: DataFrame, grid: Grid, by: Sequence[str] = ("year",), poly_key: str = "poly_id") -> DataFrame:
    """Presence cells (by..., r, c, value = 1) of all polygons, all years in one job."""
    cells = polygon_cells(polygons, grid, poly_key, by)
    return cells.select(*by, "r", "c").distinct().withColumn("value", F.lit(1.0))


def select_host(polygons: DataFrame, host_code: int, dated_area: bool = False) -> DataFrame:
    """Polygons of one host; optionally only those with an area. Unknown codes are dropped."""
    out = polygons.filter(F.col("host_code") == host_code)
    return out.filter("area IS NOT NULL") if dated_area else out
