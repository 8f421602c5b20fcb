"""Grid geometry: the affine frame that ties (r, c) cells to x/y coordinates.

A raster layer is a DataFrame with 0-based ``r`` and ``c`` BIGINT columns; a cell that
holds no value may be absent. The grid itself is a few numbers on the driver, so every
conversion below is plain column arithmetic and never needs a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def int_div(a: Column | str, b: int) -> Column:
    """Integer division that stays in BIGINT (no detour through DOUBLE)."""
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, F.lit(b))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


@dataclass(frozen=True)
class Grid:
    """North-up grid: row 0 is the northernmost row, column 0 the westernmost column."""

    xmin: float
    ymax: float
    xres: float
    yres: float
    nrow: int
    ncol: int
    crs: str | None = None

    # extent -------------------------------------------------------------------------
    @property
    def xmax(self) -> float:
        return self.xmin + self.ncol * self.xres

    @property
    def ymin(self) -> float:
        return self.ymax - self.nrow * self.yres

    @property
    def ncell(self) -> int:
        return self.nrow * self.ncol

    @property
    def cell_area(self) -> float:
        return self.xres * self.yres

    def coarsen(self, factor: int) -> Grid:
        """Grid of ``factor x factor`` blocks; edge blocks may be partly outside."""
        return Grid(
            self.xmin,
            self.ymax,
            self.xres * factor,
            self.yres * factor,
            math.ceil(self.nrow / factor),
            math.ceil(self.ncol / factor),
            self.crs,
        )

    # index conversions ----------------------------------------------------------------
    def cell_id(self, r: Column | str = "r", c: Column | str = "c") -> Column:
        """1-based row-major cell number."""
        return _c(r) * F.lit(self.ncol).cast("bigint") + _c(c) + F.lit(1).cast("bigint")

    def row_of(self, cell_id: Column | str = "cell_id") -> Column:
        return int_div(_c(cell_id) - 1, self.ncol)

    def col_of(self, cell_id: Column | str = "cell_id") -> Column:
        return (_c(cell_id) - 1) % self.ncol

    def x_of(self, c: Column | str = "c") -> Column:
        return F.lit(float(self.xmin)) + (_c(c) + F.lit(0.5)) * F.lit(float(self.xres))

    def y_of(self, r: Column | str = "r") -> Column:
        return F.lit(float(self.ymax)) - (_c(r) + F.lit(0.5)) * F.lit(float(self.yres))

    def col_at(self, x: Column | str = "x") -> Column:
        """Column holding ``x``; NULL outside. The east edge belongs to the last column."""
        x = _c(x)
        c = F.floor((x - F.lit(float(self.xmin))) / F.lit(float(self.xres)))
        return (
            F.when(x == F.lit(self.xmax), F.lit(self.ncol - 1).cast("bigint"))
            .when((c >= 0) & (c < self.ncol), c)
        )

    def row_at(self, y: Column | str = "y") -> Column:
        """Row holding ``y``; NULL outside. The south edge belongs to the last row."""
        y = _c(y)
        r = F.floor((F.lit(float(self.ymax)) - y) / F.lit(float(self.yres)))
        return (
            F.when(y == F.lit(self.ymin), F.lit(self.nrow - 1).cast("bigint"))
            .when((r >= 0) & (r < self.nrow), r)
        )

    def with_xy(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"x": self.x_of(), "y": self.y_of()})

    # domain and windows -----------------------------------------------------------------
    def domain(self, spark: SparkSession) -> DataFrame:
        """Every cell of the grid, generated in parallel without reading anything."""
        ids = spark.range(1, self.ncell + 1).withColumnRenamed("id", "cell_id")
        return ids.withColumns({"r": self.row_of(), "c": self.col_of()})

    def index_bounds(self, xmin: float, xmax: float, ymin: float, ymax: float) -> tuple[int, int, int, int]:
        """(first row, last row, first col, last col) of an extent snapped to the nearest cell edges."""

        def edge(v: float) -> int:
            return math.floor(v + 0.5)

        c0 = max(edge((xmin - self.xmin) / self.xres), 0)
        c1 = min(edge((xmax - self.xmin) / self.xres), self.ncol) - 1
        r0 = max(edge((self.ymax - ymax) / self.yres), 0)
        r1 = min(edge((self.ymax - ymin) / self.yres), self.nrow) - 1
        return r0, r1, c0, c1

    def crop(self, df: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
        """Keep the cells of an extent, as plain r/c ranges that reach the parquet scan."""
        r0, r1, c0, c1 = self.index_bounds(xmin, xmax, ymin, ymax)
        return df.filter(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))

    def cropped(self, df: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> tuple[DataFrame, Grid]:
        """The cells of an extent, numbered from its first row and column, and the extent as a grid of its own."""
        r0, r1, c0, c1 = self.index_bounds(xmin, xmax, ymin, ymax)
        x, y = self.xmin + c0 * self.xres, self.ymax - r0 * self.yres
        grid = Grid(x, y, self.xres, self.yres, r1 - r0 + 1, c1 - c0 + 1, self.crs)
        inside = self.crop(df, xmin, xmax, ymin, ymax)
        return inside.withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0}), grid

    def stride_for(self, max_cells: int) -> int:
        """Smallest stride whose systematic sample has about ``max_cells`` cells or fewer."""
        return max(1, math.ceil(math.sqrt(self.ncell / max_cells)))
