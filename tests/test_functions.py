import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellframe.functions import algebra as A
from cellframe.functions import binning as B
from cellframe.functions import geodesy as GEO
from cellframe.functions import text as TX


def column(spark, values, expr, type_name="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_name}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_clamp_makes_null_not_bound(spark):
    assert column(spark, [-1.0, 0.9, 1.0, None], lambda v: A.clamp_below(v, 0.9)) == [None, 0.9, 1.0, None]


def test_nan_becomes_null(spark):
    assert column(spark, [float("nan"), 2.0, None], A.null_if_nan) == [None, 2.0, None]


def test_quality_rule_leaves_value_when_uncertainty_unknown(spark):
    df = spark.createDataFrame(
        [(1.0, 0.1), (1.0, 0.2), (11.0, 0.1), (-0.1, 0.1), (3.0, None), (12.0, None), (None, 0.1)], "v double, u double"
    )
    got = [r[0] for r in df.select(A.quality_null(F.col("v"), F.col("u"), 0, 10, 0.15)).collect()]
    assert got == [1.0, None, None, None, 3.0, None, None]


def test_mask_cover_fill(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (None, None), (3.0, 4.0)], "a double, b double")
    got = df.select(
        A.keep_where(F.col("a"), F.col("b")), A.cover(F.col("a"), F.col("b")), A.fill_null(F.col("a"), 0.0)
    ).collect()
    assert [tuple(r) for r in got] == [(None, 1.0, 1.0), (None, 2.0, 0.0), (None, None, 0.0), (3.0, 3.0, 3.0)]


def test_na_policies(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 3.0), ("c", None)], "g string, v double")
    out = df.groupBy("g").agg(
        A.mean_of(F.col("v")).alias("skip"), A.mean_of(F.col("v"), "propagate").alias("prop"), A.sd_of(F.col("v")).alias("sd")
    )
    got = {r.g: (r.skip, r.prop, None if r.sd is None else round(r.sd, 6)) for r in out.collect()}
    assert got == {"a": (1.0, None, None), "b": (2.0, 2.0, 1.414214), "c": (None, None, None)}
    with pytest.raises(ValueError):
        A.mean_of(F.col("v"), "drop")


def scalar_bin(v, breaks):
    for i, (a, b) in enumerate(zip(breaks, breaks[1:]), 1):
        if v is not None and a < v <= b:
            return i
    return None


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from(B.ELEVATION_BREAKS), st.floats(2500, 3700)), min_size=1, max_size=20))
def test_right_closed_bins(spark, values):
    want = [scalar_bin(v, B.ELEVATION_BREAKS) for v in values]
    assert column(spark, values, lambda v: B.bin_index(v, B.ELEVATION_BREAKS)) == want
    lower = column(spark, values, lambda v: B.bin_lower(v, B.ELEVATION_BREAKS))
    assert lower == [None if k is None else B.ELEVATION_BREAKS[k - 1] for k in want]


def test_bin_labels(spark):
    got = column(spark, [2600.0, 2800.0, 2800.1, 3600.0, 3600.1, None], lambda v: B.bin_label(v, B.ELEVATION_BREAKS))
    assert got == [None, "(2600,2800]", "(2800,3000]", "(3400,3600]", None, None]
    assert column(spark, [-0.7], lambda v: B.bin_label(v, B.COS_ASPECT_BREAKS)) == ["(-1,-0.5]"]


@settings(max_examples=10, deadline=None)
@given(
    st.floats(-1e5, 1e5),
    st.sampled_from([0.1, 0.3, 1.0, 7.0, 100.0]),
    st.lists(st.one_of(st.integers(-2, 12), st.floats(-2, 12)), min_size=1, max_size=15),
)
def test_step_bins_agree_with_breaks(spark, lo, step, places):
    hi = lo + 9.5 * step
    last = math.floor((hi - lo) / step + 1e-10)
    breaks = [lo + k * step for k in range(last + 1)]
    values = [lo + p * step for p in places]
    got = column(spark, values, lambda v: B.step_index(v, F.lit(lo), F.lit(hi), step))
    assert got == [scalar_bin(v, breaks) for v in values]


def test_equal_breaks_end_on_the_maximum(spark):
    row = spark.range(1).select(*B.equal_breaks(F.lit(0.1), F.lit(0.7), 10)).first()
    assert len(row) == 10 and row[0] == 0.1 and row[-1] == 0.7
    assert all(abs(v - (0.1 + i * 0.6 / 9)) < 1e-12 for i, v in enumerate(row))


def test_text(spark):
    assert column(spark, ["r_damage_Year.2004.tif", "x/Year=1999/p.parquet", "other", None], TX.year_from_name, "string") == [
        2004,
        1999,
        None,
        None,
    ]
    assert column(spark, ["observed triploid", "observed.diploid"], lambda v: TX.strip_prefix(v, "observed"), "string") == [
        "triploid",
        "diploid",
    ]
    assert column(spark, ["W645.2", "x"], lambda v: TX.band_number(v, "W"), "string") == [645.2, None]


def test_utm_central_meridian_and_round_trip(spark):
    df = spark.createDataFrame(
        [(-105.0, 0.0), (-105.0, 45.0), (-107.3, 38.9), (-102.0, 60.0), (-108.0, 5.0)], "lon double, lat double"
    )
    x, y = GEO.to_utm(F.col("lon"), F.col("lat"), 13)
    there = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = GEO.to_lonlat(F.col("x"), F.col("y"), 13)
    rows = there.select("*", lon.alias("lon2"), lat.alias("lat2")).collect()
    assert abs(rows[0].x - 500000) < 1e-6 and abs(rows[0].y) < 1e-6
    # meridian arc to 45 degrees on GRS80, times the scale factor
    assert abs(rows[1].y - 4984944.378 * 0.9996) < 0.01
    for r in rows:
        assert abs(r.lon2 - r.lon) < 1e-8 and abs(r.lat2 - r.lat) < 1e-8
