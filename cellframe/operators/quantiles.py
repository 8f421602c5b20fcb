"""Exact quantiles with linear interpolation that never hold a group in one place: ranks by radix selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.operators.ranks import double_digits, select_ranks
from cellframe.spark import settle


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., name, _v) without NULLs."""
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(list(by), list(cols), "name", "_v").filter("_v IS NOT NULL")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Long table (by..., name, p, value): the quantile at ``(n - 1) p``, interpolated.

    Rows whose group is NULL are left out."""
    keys = [*by, "name"]
    h = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array(*[f(x).cast("bigint") for x in h for f in (F.floor, F.ceil)])
    found = select_ranks(long_values(df, cols, by), keys, ranks, double_digits)
    number = F.floor(F.col("_i") / 2)
    p = F.get(F.array(*[F.lit(float(p)) for p in probs]), number.cast("int"))
    ends = found.groupBy(*keys, "_n", p.alias("p")).agg(
        F.max(F.when(F.col("_i") % 2 == 0, F.col("_v"))).alias("_a"), F.max(F.when(F.col("_i") % 2 == 1, F.col("_v"))).alias("_b")
    )
    at = (F.col("_n") - 1) * F.col("p")
    # equal ends are the value itself, so that infinities do not meet
    between = F.col("_a") + (at - F.floor(at)) * (F.col("_b") - F.col("_a"))
    return ends.select(*keys, "p", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias("value"))


def quantiles_wide(df: DataFrame, cols: Sequence[str], probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row per (by..., name) with a column per named probability."""
    q = exact_quantiles(df, cols, sorted(set(probs.values())), by)
    return q.groupBy(*by, "name").agg(
        *[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(n) for n, p in probs.items()]
    )


def trim_by_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    low: float = 0.01,
    high: float = 0.99,
    complete: Sequence[str] | None = None,
    reread: bool = False,
) -> DataFrame:
    """Rows strictly between the low and high quantile in every column.

    ``complete`` names the columns that must be present first (all of them by default);
    all thresholds come from that same frame. The frame is read several times, so it is
    settled first; ``reread`` skips that for a frame that is stored already."""
    frame = df.dropna(subset=list(complete if complete is not None else df.columns))
    if not reread:
        frame = settle(frame)
    q = quantiles_wide(frame, cols, {"lo": low, "hi": high})
    limits = q.agg(
        *[F.struct(*[F.max(F.when(F.col("name") == c, F.col(e))).alias(e) for e in ("lo", "hi")]).alias(c) for c in cols]
    )
    one_row = limits.select(F.struct(*cols).alias("limits")).scalar()
    kept = frame.withColumn("_limits", one_row)
    for c in cols:
        kept = kept.filter((F.col(c) > F.col(f"_limits.{c}.lo")) & (F.col(c) < F.col(f"_limits.{c}.hi")))
    return kept.drop("_limits")
