"""Values at points, by site and by cell index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.grid import Grid

# The joins below carry no broadcast hint: Spark broadcasts a site or point table only
# while its measured size is under spark.sql.autoBroadcastJoinThreshold, and shuffles with
# AQE skew splitting beyond it.


def locate(points: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """Add the cell (r, c) each point falls into; NULL outside the grid."""
    return points.withColumns({"r": grid.row_at(y), "c": grid.col_at(x)})


def extract_values(
    points: DataFrame, layers: DataFrame, grid: Grid, values: Sequence[str], x: str = "x", y: str = "y"
) -> DataFrame:
    """Every point with the layer values of its cell (NULL where there is none)."""
    return locate(points, grid, x, y).join(layers.select("r", "c", *values), ["r", "c"], "left")


def join_sites(df: DataFrame, sites: DataFrame, key: str = "site_code") -> DataFrame:
    """Left join of site attributes; rows of unknown sites keep NULLs."""
    return df.join(sites, [key], "left")


def cells_by_index(cells: DataFrame, index: DataFrame, key: str = "cell_id") -> DataFrame:
    """Cells listed in an index table."""
    return cells.join(index.select(key), [key], "left_semi")


def cells_not_in(cells: DataFrame, index: DataFrame, key: str = "cell_id") -> DataFrame:
    """Cells not listed in an index table."""
    return cells.join(index.select(key), [key], "left_anti")


def cells_where(stack: DataFrame, condition: Column) -> DataFrame:
    """Cells of a stack picked by predicate: an index list that is never built."""
    return stack.filter(condition)


def in_window(points: DataFrame, x: str, y: str, centre_x: float, centre_y: float, half: float) -> DataFrame:
    """Points in a square window, edges included."""
    return points.filter(
        F.col(x).between(centre_x - half, centre_x + half) & F.col(y).between(centre_y - half, centre_y + half)
    )
