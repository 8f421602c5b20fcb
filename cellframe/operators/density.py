"""Gaussian kernel density on a fixed grid of points: the kernel of every value at every point.

Equal values are counted first, and the kernel sums combine before the shuffle, so a group's rows never meet. The work is
the rows once, and the number of points for each distinct value of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.operators.quantiles import quantiles_wide
from cellframe.spark import explode_range, lookup_join, settle

REACH = 39.0  # exp(-39 ** 2 / 2) underflows to zero


def bandwidths(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Rule-of-thumb bandwidth per group: 0.9 min(sd, IQR / 1.34) n^-0.2.

    A zero spread falls back to the sd, then to the size of a value, then to 1."""
    q = quantiles_wide(df, [value], {"_q1": 0.25, "_q3": 0.75}, by).drop("name")
    s = df.groupBy(*by).agg(
        F.count(value).alias("_n"),
        F.stddev_samp(value).alias("_sd"),
        F.min(value).alias("_lo"),
        F.max(value).alias("_hi"),
    )
    spread = F.least(F.col("_sd"), (F.col("_q3") - F.col("_q1")) / F.lit(1.34))
    spread = F.coalesce(
        F.nullif(spread, F.lit(0.0)),
        F.nullif(F.col("_sd"), F.lit(0.0)),
        F.nullif(F.abs("_lo"), F.lit(0.0)),
        F.lit(1.0),
    )
    return s.join(q, list(by)).withColumn("_bw", F.lit(0.9) * spread * F.pow(F.col("_n"), F.lit(-0.2)))


def density(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    limits: tuple[float, float] | None = (0.0, 1.0),
    points: int = 512,
) -> DataFrame:
    """Density (by..., i, x, density) at ``points`` equally spaced places.

    ``limits`` restricts the values first and spans the grid; without them the grid spans
    each group's own range. Equal values are counted before the kernel is applied, and the
    sums combine before the shuffle, so a hot group costs no more than any other."""
    by = list(by)
    df = df.select(*by, F.col(value).cast("double").alias("_v")).dropna()
    if limits is not None:
        df = df.filter(F.col("_v").between(*limits))
    bw = bandwidths(df, "_v", by)
    if limits is not None:
        bw = bw.withColumns({"_lo": F.lit(float(limits[0])), "_hi": F.lit(float(limits[1]))})
    bw = settle(bw.select(*by, "_n", "_bw", "_lo", "_hi"), small=True)
    last = F.lit(points - 1)
    step = (F.col("_hi") - F.col("_lo")) / last.cast("double")
    x = F.col("_lo") + F.col("i") * step
    # one row per distinct value is little data but much work: spread it before it multiplies
    # (by value only: the same keys as the count's would be optimized away)
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counts = df.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_k"))
    spread = lookup_join(counts, bw, by, settled=True).repartition(tasks, "_v")
    # beyond REACH bandwidths exp() is exactly zero, so those points need no visit
    reach = F.lit(REACH) * F.col("_bw")
    first = F.when(step > 0, F.greatest(F.ceil((F.col("_v") - reach - F.col("_lo")) / step), F.lit(0))).otherwise(0)
    final = F.when(step > 0, F.least(F.floor((F.col("_v") + reach - F.col("_lo")) / step), last)).otherwise(last)
    u = (x - F.col("_v")) / F.col("_bw")
    sums = (
        explode_range(spread, first, final, "i")
        .groupBy(*by, "i")
        .agg(F.sum(F.col("_k") * F.exp(F.lit(-0.5) * u * u)).alias("_sum"))
    )
    grid = bw.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    scale = F.col("_n") * F.col("_bw") * F.sqrt(F.lit(2.0) * F.pi())
    return grid.join(sums, [*by, "i"], "left").select(
        *by, F.col("i").cast("int").alias("i"), x.alias("x"), (F.coalesce("_sum", F.lit(0.0)) / scale).alias("density")
    )


def violin(
    df: DataFrame, value: str, by: Sequence[str], points: int = 512, limits: tuple[float, float] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(median per group, density per group over the group's own range); a facet is one more column of ``by``.

    Values outside ``limits`` are left out first, of the median as well."""
    if limits is not None:
        df = df.filter(F.col(value).between(*limits))
    median = quantiles_wide(df, [value], {"median": 0.5}, by).drop("name")
    return median, density(df, value, by, limits=None, points=points)
