"""Registered queries over the given tables, each with its SQL counterpart."""

from cellframe.catalog import blocks, composites, files, forests, joins, small, spectra, tables, vector  # noqa: F401
from cellframe.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
