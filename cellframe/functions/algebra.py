"""Cell-wise map algebra with NULL as the only missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quality limits of the two trait layers (lowest, highest, largest uncertainty).
TRAIT_LIMITS = {
    "trait_n": (0.0, 10.0, 0.15),
    "trait_d13c": (-30.0, -22.0, 0.8),
}


def null_if_nan(v: Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    return F.when(~F.isnan(v), v)


def clamp_below(v: Column, lower: float) -> Column:
    """Values under ``lower`` become NULL (they are not raised to the bound)."""
    return F.when(v >= F.lit(lower), v)


def keep_where(v: Column, mask: Column) -> Column:
    """Value where the mask layer has a value, NULL elsewhere."""
    return F.when(mask.isNotNull(), v)


def null_where(v: Column, cond: Column) -> Column:
    """Value unless the condition is TRUE; an unknown condition leaves the value alone."""
    return F.when(cond, F.lit(None)).otherwise(v)


def quality_null(v: Column, uncertainty: Column, low: float, high: float, max_uncertainty: float) -> Column:
    return null_where(v, (uncertainty > F.lit(max_uncertainty)) | (v < F.lit(low)) | (v > F.lit(high)))


def presence(v: Column) -> Column:
    return v.isNotNull()


def fill_null(v: Column, constant: float) -> Column:
    return F.coalesce(v, F.lit(constant))


def cover(first: Column, second: Column) -> Column:
    """First layer, and the second one where the first has no value."""
    return F.coalesce(first, second)


def above(v: Column, threshold: float) -> Column:
    """1.0 / 0.0 / NULL layer of ``v > threshold``."""
    return (v > F.lit(threshold)).cast("double")


def scale_presence(present: Column, year: Column) -> Column:
    """The year where the layer is present, NULL elsewhere."""
    return F.when(present, year)


def recode_threshold(v: Column, threshold: float, high: str, low: str) -> Column:
    """Label by threshold; NULL stays NULL."""
    return F.when(v > F.lit(threshold), F.lit(high)).when(v.isNotNull(), F.lit(low))


def mean_of(v: Column, na_policy: str = "skip") -> Column:
    """Group mean. ``skip`` ignores NULLs; ``propagate`` gives NULL if any value is NULL."""
    return _na(F.avg(v), v, na_policy)


def sd_of(v: Column, na_policy: str = "skip") -> Column:
    """Group sample standard deviation (NULL for a single value)."""
    return _na(F.stddev_samp(v), v, na_policy)


def _na(agg: Column, v: Column, na_policy: str) -> Column:
    if na_policy == "skip":
        return agg
    if na_policy == "propagate":
        return F.when(F.count(F.lit(1)) == F.count(v), agg)
    raise ValueError(f"na_policy must be 'skip' or 'propagate', not {na_policy!r}")


def variation(sd: Column, mean: Column) -> Column:
    """Coefficient of variation, with the magnitude of the mean below the line."""
    return sd / F.abs(mean)
