"""Per-pixel spectra: one array per row, unpivoted to bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.algebra import mean_of, sd_of

# The 1-based ranges of unusable bands out of 426, and the reflectance scale.
BAD_BANDS = [(1, 9), (193, 206), (285, 328), (418, 426)]
REFLECTANCE_SCALE = 10000.0


def bad_band(band: Column, ranges: Sequence[tuple[int, int]] = tuple(BAD_BANDS)) -> Column:
    cond = F.lit(False)
    for lo, hi in ranges:
        cond = cond | band.between(lo, hi)
    return cond


def to_bands(
    df: DataFrame,
    keep: Sequence[str],
    wavelengths: Sequence[float] | Column,
    spectrum: str = "refl",
    scale: float = REFLECTANCE_SCALE,
    bad: Sequence[tuple[int, int]] = tuple(BAD_BANDS),
) -> DataFrame:
    """(keep..., band, wavelength, reflectance); unusable bands stay as NULL rows.

    Row filters belong before this call: it multiplies rows by the number of bands."""
    long = df.select(*keep, F.posexplode(spectrum).alias("_i", "_v")).withColumn("band", F.col("_i") + 1)
    if isinstance(wavelengths, Column):
        wl = wavelengths
    else:
        wl = F.get(F.array(*[F.lit(float(w)) for w in wavelengths]), F.col("_i"))
    value = F.when(~bad_band(F.col("band"), bad), F.col("_v").cast("double") / F.lit(scale))
    return long.select(*keep, "band", wl.alias("wavelength"), value.alias("reflectance"))


def wide_to_bands(df: DataFrame, keep: Sequence[str], prefix: str = "W", scale: float = REFLECTANCE_SCALE) -> DataFrame:
    """The same long table out of one column per band, named by wavelength."""
    bands = [c for c in df.columns if c.startswith(prefix)]
    long = df.select(*keep, *[F.col(f"`{b}`").cast("double").alias(b) for b in bands]).unpivot(
        list(keep), [F.col(f"`{b}`") for b in bands], "key", "value"
    )
    return long.select(
        *keep,
        F.regexp_replace("key", f"^{prefix}", "").try_cast("double").alias("wavelength"),
        (F.col("value") / F.lit(scale)).alias("reflectance"),
    )


def spectral_summary(
    long: DataFrame, by: str, na_policy: str | Sequence[str] = "propagate", exclude: Sequence[str] = ()
) -> DataFrame:
    """Mean, sd and the mean +- sd ribbon per (wavelength, class).

    Rows without a class are dropped, as are the labels in ``exclude``. The reference
    point is ``propagate``: one missing value makes the group's summary NULL. Several
    policies come from one aggregation and give a row each, with a column ``policy``."""
    rows = long.filter(F.col(by).isNotNull())
    if exclude:
        rows = rows.filter(~F.col(by).isin(list(exclude)))
    v = F.col("reflectance")
    policies = [na_policy] if isinstance(na_policy, str) else list(na_policy)
    each = [F.struct(F.lit(p).alias("policy"), mean_of(v, p).alias("m"), sd_of(v, p).alias("s")) for p in policies]
    out = rows.groupBy("wavelength", by).agg(F.array(*each).alias("_each")).select("wavelength", by, F.inline("_each"))
    if isinstance(na_policy, str):
        out = out.drop("policy")
    return out.withColumns({"lower": F.col("m") - F.col("s"), "upper": F.col("m") + F.col("s")})
