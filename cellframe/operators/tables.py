"""Contingency tables, shares, chi-square and binned counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most levels of a column in a contingency table; a column with more is no factor and stops the job.
MAX_LEVELS = 1000


def _levels(counts: DataFrame, col: str) -> Column:
    """Array of the levels of a column. One level more than allowed is enough to refuse the column."""
    found = counts.select(col).distinct().limit(MAX_LEVELS + 1).agg(F.collect_list(col)).scalar()
    refuse = F.raise_error(F.lit(f"{col} has more than {MAX_LEVELS} levels"))
    return F.when(F.size(found) <= MAX_LEVELS, found).otherwise(refuse.cast(f"array<{counts.schema[col].dataType.simpleString()}>"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of every (a, b) combination of the levels that occur; NULLs are left out.

    The data are counted first; only the count table, whose size is the number of level
    pairs, is completed with zeros. More than MAX_LEVELS levels are an error."""
    counts = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("freq"))
    levels = df.sparkSession.range(1).select(_levels(counts, a).alias("_a"), _levels(counts, b).alias("_b"))
    table = levels.select(F.explode("_a").alias(a), "_b").select(a, F.explode("_b").alias(b))
    return table.join(counts, [a, b], "left").withColumn("freq", F.coalesce("freq", F.lit(0).cast("bigint")))


def with_share(table: DataFrame, within: str, count: str = "freq", name: str = "share") -> DataFrame:
    """Share of each count in its column total (over the finished count table)."""
    return table.withColumn(name, F.col(count) / F.sum(count).over(Window.partitionBy(within)))


def totals(table: DataFrame, by: str, count: str = "freq", name: str = "n_cells") -> DataFrame:
    return table.groupBy(by).agg(F.sum(count).alias(name))


def chi_square(table: DataFrame, a: str, b: str, count: str = "freq", correct: bool = True) -> DataFrame:
    """Pearson chi-square of a contingency table, one row (n, df, statistic).

    A 2x2 table gets the continuity correction unless ``correct`` is off: each deviation
    shrinks by 0.5, or by the smallest deviation when that is less."""
    n = F.sum(count).over(Window.partitionBy(F.lit(1)))
    expected = F.sum(count).over(Window.partitionBy(a)) * F.sum(count).over(Window.partitionBy(b)) / n
    e, d = F.col("e"), F.col("d")
    sums = (
        table.select(a, b, F.col(count).alias("o"), expected.alias("e"), n.alias("n"))
        .withColumn("d", F.abs(F.col("o") - e))
        .agg(
            F.max("n").alias("n"),
            F.count_distinct(a).alias("ra"),
            F.count_distinct(b).alias("rb"),
            F.min("d").alias("dmin"),
            F.sum(d * d / e).alias("s2"),
            F.sum(d / e).alias("s1"),
            F.sum(1 / e).alias("s0"),
        )
    )
    is_2x2 = (F.col("ra") == 2) & (F.col("rb") == 2)
    y = F.when(is_2x2, F.least(F.lit(0.5), F.col("dmin"))).otherwise(0.0) if correct else F.lit(0.0)
    # sum of (d - y)^2 / e, multiplied out
    statistic = F.col("s2") - 2 * y * F.col("s1") + y * y * F.col("s0")
    return sums.select("n", ((F.col("ra") - 1) * (F.col("rb") - 1)).alias("df"), statistic.alias("statistic"))


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(chi-square with ``df`` degrees of freedom > x) as a column, for any whole df.

    The tail of one degree is the complementary error function, by its series below x = 8 and by its continued fraction
    above; that of two is exp(-x / 2). Two degrees more add one term each, the incomplete gamma function's recurrence."""
    h = x / 2
    decay = F.exp(-h)
    zero, one = F.lit(0.0), F.lit(1.0)

    def terms(n: Column, first: Column, shift: float) -> Column:
        """first + first * h / (1 + shift) + ...: n terms."""

        def step(acc: Column, j: Column) -> Column:
            return F.struct((acc["s"] + acc["t"]).alias("s"), (acc["t"] * h / (j + F.lit(shift))).alias("t"))

        start = F.struct(zero.alias("s"), first.alias("t"))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: acc["s"])).otherwise(zero)

    root = F.sqrt(F.lit(math.pi))
    # erf(z) = 2 z exp(-z^2) / sqrt(pi) * sum of (2 z^2)^n / (1 * 3 * ... * (2n + 1)), with z^2 = h
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(one.alias("s"), one.alias("t")),
        lambda acc, n: F.struct((acc["s"] + acc["t"] * 2 * h / (2 * n + 1)).alias("s"), (acc["t"] * 2 * h / (2 * n + 1)).alias("t")),
        lambda acc: acc["s"],
    )
    below = one - 2 * F.sqrt(h) * decay / root * series
    fraction = F.aggregate(F.sequence(F.lit(200), F.lit(1), F.lit(-1)), one, lambda f, i: one + i / (2 * h) / f)
    above = decay / (F.sqrt(h) * root) / fraction
    odd = F.when(x < 8, below).otherwise(above) + terms(((df - 1) / 2).cast("int"), F.sqrt(h) * decay * 2 / root, 0.5)
    even = terms((df / 2).cast("int"), decay, 0.0)
    return F.when(x <= 0, one).when(df % 2 == 1, odd).otherwise(even)


def chi_square_test(table: DataFrame, a: str, b: str, count: str = "freq", correct: bool = True) -> DataFrame:
    """chi_square with its p-value."""
    return chi_square(table, a, b, count, correct).withColumn("p_value", chi_square_tail(F.col("statistic"), F.col("df")))


def grouped_count(df: DataFrame, by: Sequence[str | Column], name: str = "n") -> DataFrame:
    """Counts per group; NULL is a group of its own."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def smallest_class(df: DataFrame, label: str) -> DataFrame:
    """Size of the smallest class, one row."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n_min"))


def with_sqrt_share(table: DataFrame, count: str = "n", name: str = "sqrt_share") -> DataFrame:
    """Square root of each count's share of the whole (finished, bin-bounded) table."""
    total = F.sum(count).over(Window.partitionBy(F.lit(1)))
    return table.withColumn(name, F.sqrt(F.col(count) / total))


def longest_label_rows(results: DataFrame, label: str, size: str, run_id: str = "run_id") -> DataFrame:
    """Runs at the largest sample size that use the longest label (first such label wins)."""
    best = results.agg(
        F.struct(
            F.max(size).alias("size"),
            F.max_by(label, F.struct(F.length(label), -F.col(run_id))).alias("label"),
        ).alias("best")
    ).scalar()
    return (
        results.withColumn("_best", best)
        .filter((F.col(size) == F.col("_best.size")) & (F.col(label) == F.col("_best.label")))
        .drop("_best")
    )
