"""Samples without replacement that do not depend on how the data are laid out.

Rows are ordered by a hash of their id and a seed. The cut hash of the wanted size is
found by counting its digits, so a sample is a filter on the data: nothing is sorted
globally and nothing passes through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.grid import Grid
from cellframe.operators.ranks import select_ranks, text_digits
from cellframe.spark import lookup_join

def hash_order(row_id: Column | str, seed: int | str | Column) -> Column:
    """Hash that puts rows into a random but repeatable order; the seed may be a column."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    tail = F.concat(F.lit(":"), seed) if isinstance(seed, Column) else F.lit(f":{seed}")
    return F.md5(F.concat(row_id.cast("string"), tail))


def cut_hash(df: DataFrame, row_id: str, size: Column, seed: int | str | Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., _cut): hash of the ``size``-th row of each group; no row when size < 1.

    ``size`` is an expression over ``_n``, the size of the group."""
    hashed = df.select(*by, hash_order(row_id, seed).alias("_v"))
    want = F.least(size.cast("bigint"), F.col("_n"))
    ranks = F.when(want >= 1, F.array(want - 1)).otherwise(F.array().cast("array<bigint>"))
    return select_ranks(hashed, by, ranks, text_digits(32)).select(*by, F.col("_v").alias("_cut"))


def sample_rows(df: DataFrame, row_id: str, size: int | Column, seed: int | str = 1) -> DataFrame:
    """Uniform sample of ``size`` rows (all rows when there are fewer)."""
    size = size if isinstance(size, Column) else F.lit(int(size))
    cut = cut_hash(df, row_id, size, seed).agg(F.max("_cut")).scalar()
    return df.filter(hash_order(row_id, seed) <= cut)


def sample_balanced(
    df: DataFrame, row_id: str, label: str, seed: int | str = 1, size: int | None = None, divide_by: int | None = None
) -> DataFrame:
    """The same number of rows from every class.

    ``size`` is the total to share out, by default the size of the smallest class.
    ``divide_by`` defaults to the number of classes; pass 2 for the halving rule."""
    df = df.filter(F.col(label).isNotNull())
    facts = (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.min("_n").alias("smallest"), F.count(F.lit(1)).alias("classes"))
        .first()
    )
    total = size if size is not None else facts.smallest or 0
    parts = divide_by if divide_by is not None else max(facts.classes, 1)
    cuts = cut_hash(df, row_id, F.lit(int(total // parts)), seed, [label])
    return lookup_join(df, cuts, [label]).filter(hash_order(row_id, seed) <= F.col("_cut")).drop("_cut")


def stride_sample(df: DataFrame, grid: Grid, max_cells: int) -> DataFrame:
    """Systematic sample of every k-th row and column, as (x, y, ...)."""
    k = grid.stride_for(max_cells)
    return grid.with_xy(df.filter((F.col("r") % k == 0) & (F.col("c") % k == 0)))
