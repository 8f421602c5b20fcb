"""Raster cells, survey polygons, field sites and spectra as Spark DataFrames."""

from cellframe.grid import Grid

__all__ = ["Grid"]
