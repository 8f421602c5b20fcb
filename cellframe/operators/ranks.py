"""Values at given ranks by radix selection: digits are counted from the top, and only a wanted rank's bucket goes on.

A value is a row of digits that order like it. A round counts one digit of the rows in the buckets of wanted ranks, so it
returns at most DIGIT + 1 rows a bucket whatever the distribution, and combines them before the shuffle; running totals
name the bucket of each rank for the next round. When few rows are left in all buckets their values are counted as they
are; after the last digit a bucket is one value. No task sorts or holds more than that, neither for a hot group nor for
one value that fills it, and results do not depend on how rows are laid out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.spark import MAX_BROADCAST_ROWS, settle

#: Values of a digit.
DIGIT = 1 << 16
#: Rows in the wanted buckets, all together, whose values are counted directly.
DIRECT = 1_000_000

Digits = Callable[[Column], list[Column]]


def double_digits(v: Column) -> list[Column]:
    """Sign, exponent and 4 bits of the fraction, then 3 times 16 bits of it; infinities come last, both zeros are one."""
    size = F.abs(v)
    about = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1074)), F.lit(1023))
    power = F.pow(F.lit(2.0), about)
    # the logarithm may be off by one next to a power of two
    e = about + F.when(size >= 2 * power, 1).otherwise(0) - F.when(size < power, 1).otherwise(0)
    fraction = F.floor((size / F.pow(F.lit(2.0), e) - 1) * F.lit(float(1 << 52))).cast("bigint")
    finite = size < F.lit(float("inf"))
    fraction = F.when(finite, fraction).otherwise(0)
    sign = F.signum(v).cast("bigint")
    first = F.when(finite, (e + 1075) * 16 + F.shiftright(fraction, 48)).otherwise(2100 * 16)
    digits = [first, *(F.shiftright(fraction, k).bitwiseAND(F.lit(DIGIT - 1)) for k in (32, 16, 0))]
    return [F.when(v == 0, 0).otherwise(sign * d).cast("bigint") for d in digits]


def text_digits(length: int, width: int = 4) -> Digits:
    """Digits of hash texts of ``length`` figures, ``width`` hexadecimal figures each."""
    return lambda v: [F.substring(v, k + 1, width) for k in range(0, length, width)]


def _placed(counts: DataFrame, bucket: Sequence[str], order: str) -> DataFrame:
    """Counts with the number of rows in their bucket (_n) and before them in it (_before)."""
    whole = Window.partitionBy(*(bucket or [F.lit(1)]))  # at most DIGIT + 1 rows, or DIRECT values
    return counts.withColumns({"_n": F.sum("_k").over(whole), "_before": F.sum("_k").over(whole.orderBy(order)) - F.col("_k")})


def _inside(wanted: Column) -> Column:
    """The wanted ranks (i, rank) that fall among a bucket's rows, counted from its first."""
    moved = F.transform(wanted, lambda w: F.struct(w["i"].alias("i"), (w["rank"] - F.col("_before")).alias("rank")))
    return F.filter(moved, lambda w: (w["rank"] >= 0) & (w["rank"] < F.col("_k")))


def select_ranks(values: DataFrame, keys: Sequence[str], ranks: Column, digits: Digits, direct: int = DIRECT) -> DataFrame:
    """(keys..., _n, _i, _v): the ``_v`` at each rank of every group of ``values`` (keys..., _v), from 0.

    ``ranks`` is an array over ``_n``, the group's rows; ``_i`` is a rank's place in it. Rows with a null key or value
    take no part. ``values`` is read once a round, twice for up to ``direct`` rows."""
    keys = list(keys)
    parts = [d.alias(f"_d{k}") for k, d in enumerate(digits(F.col("_v")))]
    rows = values.select(*keys, "_v", *parts).dropna(subset=[*keys, "_v"])
    placed = _placed(rows.groupBy(*keys, "_d0").agg(F.count(F.lit(1)).alias("_k")), keys, "_d0")
    wanted = F.transform("_ranks", lambda r, i: F.struct(i.alias("i"), r.alias("rank")))
    placed = placed.withColumn("_ranks", ranks)
    found = settle(placed.withColumn("_w", _inside(wanted)).filter("size(_w) > 0").drop("_before", "_ranks"), small=True)
    for level in range(1, len(parts) + 1):
        bucket = [*keys, *(f"_d{k}" for k in range(level))]
        size = found.agg(F.sum("_k").alias("rows"), F.count(F.lit(1)).alias("buckets")).first()
        last = level == len(parts) or (size.rows or 0) <= direct
        small = (lambda df: F.broadcast(df)) if size.buckets <= MAX_BROADCAST_ROWS else (lambda df: df)
        inside = rows.join(small(found.select(*bucket)), bucket)
        digit = "_v" if last else f"_d{level}"
        placed = _placed(inside.groupBy(*bucket, digit).agg(F.count(F.lit(1)).alias("_k")), bucket, digit)
        found = placed.drop("_n").join(small(found.select(*bucket, "_n", "_w")), bucket).withColumn("_w", _inside(F.col("_w"))).filter("size(_w) > 0")
        if last:
            return found.select(*keys, "_n", F.explode("_w.i").alias("_i"), "_v")
        found = settle(found.select(*bucket, digit, "_n", "_k", "_w"), small=True)
    raise AssertionError("the last level returns")
