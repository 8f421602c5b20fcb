import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellframe.catalog import QUERIES
from cellframe.operators import confusion as C
from cellframe.operators import density as D
from cellframe.operators import quantiles as Q
from cellframe.operators import spectra as SP
from cellframe.operators import tables as T


# quantiles ----------------------------------------------------------------------------


@settings(max_examples=6, deadline=None)
@given(
    st.lists(st.one_of(st.none(), st.integers(0, 4), st.floats(-1e6, 1e6)), min_size=1, max_size=40).filter(
        lambda v: any(x is not None for x in v)
    ),
    st.sampled_from([[0.01, 0.99], [0.0, 0.5, 1.0], [0.25, 0.75]]),
)
def test_quantiles_are_linear_interpolation(spark, values, probs):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    got = {r.p: r.value for r in Q.exact_quantiles(df, ["v"], probs).collect()}
    have = [float(v) for v in values if v is not None]
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(have, p), rel=1e-12, abs=1e-9)


SHAPES = {
    "heavy tail": [1.0 / (1 + k * 7919 % 5003) ** 4 for k in range(5000)],
    "sorted": [float(k) for k in range(5000)],
    "one value": [3.25] * 4000 + [1.0, 7.0],
    "both signs": [(-1.0) ** k * 2.0 ** (k % 600 - 300) for k in range(5000)],
    "edges": [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 1.0, 1.0 + 2.0**-52, 2.0 - 2.0**-52, 2.0, 1.7e308, -1.7e308],
    "powers": [float(2**k + d) for k in range(1, 52) for d in (-1, 0, 1)],
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("direct", [10, 1_000_000])
def test_quantiles_by_radix(spark, shape, direct, monkeypatch):
    """Every digit, and every distribution: with few direct rows all rounds run."""
    from cellframe.operators import ranks

    monkeypatch.setattr(ranks.select_ranks, "__defaults__", (direct,))
    v = SHAPES[shape]
    df = spark.createDataFrame([(x,) for x in [*v, None]], "v double").repartition(7)
    probs = [0.0, 0.001, 0.25, 0.5, 0.999, 1.0]
    got = {r.p: r.value for r in Q.exact_quantiles(df, ["v"], probs).collect()}
    have = sorted(v)
    for p in probs:
        h = (len(v) - 1) * p
        a, b = have[int(h)], have[min(int(h) + (h > int(h)), len(v) - 1)]
        assert got[p] == pytest.approx(a + (h - int(h)) * (b - a), rel=1e-12, abs=0)


def test_digits_order_like_values(spark):
    from cellframe.operators.ranks import DIGIT, double_digits

    v = sorted({x for s in SHAPES.values() for x in s} | {float("inf"), float("-inf"), 0.1, 1 / 3, 1e-310})
    df = spark.createDataFrame([(x,) for x in v], "_v double")
    rows = df.select("_v", *[d.alias(f"d{k}") for k, d in enumerate(double_digits(F.col("_v")))]).collect()
    digits = [tuple(r[1:]) for r in sorted(rows, key=lambda r: r[0])]
    assert digits == sorted(digits) and len(set(digits)) == len({x + 0.0 for x in v})
    assert all(abs(d) <= DIGIT for t in digits for d in t)


def test_quantile_job_count(spark):
    sc = spark.sparkContext
    df = spark.range(20000).select((F.col("id") % 977).cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    sc.setJobGroup("quantiles", "quantiles")
    Q.quantiles_wide(df, ["a", "b"], {"lo": 0.01, "hi": 0.99}).collect()
    executions = len(sc.statusTracker().getJobIdsForGroup("quantiles"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert executions <= 15  # adaptive execution makes every shuffle a job of its own


def test_grouped_quantiles(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 3001).cast("double").alias("v"))
    want = {g: np.quantile([i * 7919 % 3001 for i in range(g, 3000, 3)], 0.25) for g in range(3)}
    got = {r.g: r.value for r in Q.exact_quantiles(df, ["v"], [0.25], ["g"]).collect()}
    assert got == pytest.approx(want)


def test_trim_is_strict_and_uses_one_frame(spark):
    df = spark.range(1, 202).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") > 1, 1.0 * F.col("id")).alias("b"))
    kept = Q.trim_by_quantiles(df, ["a", "b"], 0.1, 0.9)
    # complete rows are 2..201: 10% = 21.9, 90% = 181.1
    assert kept.agg(F.min("a"), F.max("a"), F.count("*")).first() == (22.0, 181.0, 160)


# contingency and chi-square -----------------------------------------------------------


def pairs(spark, counts):
    rows = [(a, b) for (a, b), n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "a string, b string")


def test_contingency_is_zero_filled_and_skips_nulls(spark):
    df = pairs(spark, {("x", "p"): 3, ("y", "q"): 2, ("x", None): 4, (None, "p"): 1})
    tab = T.contingency(df, "a", "b")
    assert {(r.a, r.b): r.freq for r in tab.collect()} == {("x", "p"): 3, ("x", "q"): 0, ("y", "p"): 0, ("y", "q"): 2}
    share = {(r.a, r.b): r.share for r in T.with_share(tab, "b").collect()}
    assert share[("x", "p")] == 1 and share[("y", "p")] == 0
    assert {(r.b, r.n_cells) for r in T.totals(tab, "b").collect()} == {("p", 3), ("q", 2)}


def test_chi_square_golden(spark):
    tab = T.contingency(pairs(spark, {("x", "p"): 30, ("x", "q"): 10, ("y", "p"): 15, ("y", "q"): 25}), "a", "b")
    with_correction = T.chi_square_test(tab, "a", "b").first()
    assert with_correction.statistic == pytest.approx(9.955556, abs=1e-6)
    assert with_correction.df == 1 and with_correction.n == 80
    assert with_correction.p_value == pytest.approx(0.0016039, abs=1e-6)
    assert T.chi_square(tab, "a", "b", correct=False).first().statistic == pytest.approx(11.428571, abs=1e-6)


def test_chi_square_tail_of_published_points(spark):
    points = [
        (3.841458820694124, 1, 0.05), (10.827566170662733, 1, 0.001), (6.634896601021213, 1, 0.01), (23.928126, 1, 1e-6),
        (5.991464547107979, 2, 0.05), (13.815510557964274, 2, 0.001), (7.814727903251179, 3, 0.05), (13.276704135987622, 4, 0.01),
        (20.515005652432873, 5, 0.001), (18.307038053275146, 10, 0.05), (43.77297182574219, 30, 0.05), (1.689869, 7, 0.975),
        (124.34211340400407, 100, 0.05), (0.0, 3, 1.0), (0.00393214, 1, 0.95),
    ]
    df = spark.createDataFrame([(x, k) for x, k, _ in points], "x double, k long")
    got = [r.p for r in df.select(T.chi_square_tail(F.col("x"), F.col("k")).alias("p")).collect()]
    for p, (x, k, want) in zip(got, points, strict=True):
        digits = 1e-9 if len(str(x)) > 12 else 1e-4 * want
        assert p == pytest.approx(want, abs=digits), (x, k)
    # both branches of one degree meet, and odd degrees lie between even ones
    edge = spark.createDataFrame([(8 - 1e-12, 1), (8.0, 1), (8.0, 2), (8.0, 3)], "x double, k long")
    a, b, c, d = [r.p for r in edge.select(T.chi_square_tail(F.col("x"), F.col("k")).alias("p")).collect()]
    assert a == pytest.approx(b, rel=1e-11) and b < c < d and c == pytest.approx(math.exp(-4), rel=1e-14)


def test_chi_square_larger_table_has_no_correction(spark):
    counts = {("x", "p"): 12, ("x", "q"): 5, ("x", "s"): 9, ("y", "p"): 7, ("y", "q"): 14, ("y", "s"): 3}
    tab = T.contingency(pairs(spark, counts), "a", "b")
    n = sum(counts.values())
    e = lambda a, b: sum(v for k, v in counts.items() if k[0] == a) * sum(v for k, v in counts.items() if k[1] == b) / n
    want = sum((v - e(*k)) ** 2 / e(*k) for k, v in counts.items())
    got = T.chi_square_test(tab, "a", "b").first()
    assert got.statistic == pytest.approx(want) and got.df == 2
    assert got.p_value == pytest.approx(math.exp(-want / 2))


def test_longest_label_takes_the_first_of_equals(spark):
    runs = spark.createDataFrame(
        [(1, 9, "a+b"), (2, 9, "b+c"), (3, 9, "a"), (4, 5, "a+b+c"), (5, 9, "a+b")], "run_id int, np int, x string"
    )
    assert T.longest_label_rows(runs, "x", "np").count() == 0  # the longest label was not run at the largest size
    assert {r.run_id for r in T.longest_label_rows(runs.filter("np = 9"), "x", "np").collect()} == {1, 5}


# confusion ----------------------------------------------------------------------------

# Published two-class counts (tp, fp, fn, tn) and the rates they give.
CYTOTYPE = {
    "test": ((533, 113, 104, 747), (0.8367, 0.8686, 0.8550)),
    "train": ((2743, 530, 324, 2314), (0.8944, 0.8136, 0.8555)),
}


@pytest.mark.parametrize("part", CYTOTYPE)
def test_cytotype_rates(spark, part):
    (tp, fp, fn, tn), want = CYTOTYPE[part]
    rows = [("predicted triploid", tp, fp), ("predicted diploid", fn, tn)]
    m = spark.createDataFrame(rows, "X string, `observed triploid` bigint, `observed diploid` bigint")
    tidy = C.tidy_crosstab(m, "X", ["observed triploid", "observed diploid"])
    assert tidy.count() == 4
    r = C.rates(C.one_vs_rest(tidy, "triploid")).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, fn, tn)
    assert (round(r.sensitivity, 4), round(r.specificity, 4), round(r.accuracy, 4)) == want


# Published nine-class test counts, rows observed, columns predicted.
COVER_TEST = [
    [667, 0, 2, 4, 2, 0, 0, 0, 10],
    [0, 488, 0, 0, 1, 4, 0, 1, 0],
    [2, 0, 575, 4, 0, 0, 0, 0, 5],
    [0, 0, 0, 419, 2, 0, 0, 0, 2],
    [0, 0, 0, 4, 527, 0, 0, 0, 1],
    [0, 0, 0, 5, 0, 634, 0, 0, 0],
    [0, 0, 0, 0, 0, 0, 616, 2, 0],
    [0, 1, 0, 0, 0, 0, 0, 536, 0],
    [2, 0, 0, 8, 8, 0, 0, 0, 544],
]


def test_cover_rates(spark):
    ddl = "observed string, " + ", ".join(f"`{c}` bigint" for c in C.COVER_CLASSES)
    m = spark.createDataFrame([(n, *v) for n, v in zip(C.COVER_CLASSES, COVER_TEST)], ddl)
    tidy = C.tidy_square(m, "observed", C.COVER_CLASSES)
    assert tidy.count() == 81
    r = C.rates(C.one_vs_rest(tidy, C.COVER_CLASSES[0])).first()
    assert (r.tp, r.fn, r.fp, r.tn) == (667, 18, 4, 4387)
    assert (round(r.sensitivity, 4), round(r.specificity, 4)) == (0.9737, 0.9991)
    right = tidy.agg(F.sum(F.when(F.col("observed") == F.col("predicted"), F.col("value"))) / F.sum("value")).first()[0]
    assert round(right, 4) == 0.9862


def test_r2_is_squared_correlation(spark):
    df = spark.createDataFrame([(1.0, 12.0), (2.0, 14.1), (3.0, 15.9), (4.0, 18.0)], "y double, p double")
    r = C.regression_stats(df, "y", "p").first()
    y, p = np.array([1, 2, 3, 4.0]), np.array([12, 14.1, 15.9, 18])
    assert r.r2 == pytest.approx(np.corrcoef(y, p)[0, 1] ** 2)
    assert r.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()))


# density and spectra ------------------------------------------------------------------


def rule_of_thumb(v):
    sd, iqr = np.std(v, ddof=1), np.quantile(v, 0.75) - np.quantile(v, 0.25)
    return 0.9 * (min(sd, iqr / 1.34) or sd or abs(v[0]) or 1) * len(v) ** -0.2


@pytest.mark.parametrize("values", [[0.1, 0.2, 0.2, 0.9, 0.4], [0.3, 0.3, 0.3, 0.3, 0.9], [0.5, 0.5], list(np.linspace(0, 1, 200) ** 9)])
def test_density_matches_the_formula(spark, values):
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("a", 3.0), ("a", None)], "g string, v double")
    got = D.density(df, "v", ["g"], points=64).orderBy("i").collect()
    v, bw = np.array(values), rule_of_thumb(np.array(values))
    x = np.linspace(0, 1, 64)
    want = np.exp(-0.5 * ((x[:, None] - v) / bw) ** 2).sum(1) / (len(v) * bw * math.sqrt(2 * math.pi))
    assert [r.i for r in got] == list(range(64))
    assert np.allclose([r.x for r in got], x)
    assert np.allclose([r.density for r in got], want, rtol=1e-9, atol=1e-12)


def every_kernel(v, lo, hi, digits):
    """The sum over all values, of every one on its own."""
    v, x = np.asarray(v, dtype=float), np.linspace(lo, hi, 512)
    bw = rule_of_thumb(v)
    return np.round(np.exp(-0.5 * ((x[:, None] - v) / bw) ** 2).sum(1) / (len(v) * bw * math.sqrt(2 * math.pi)), digits)


def check_density(rows, by, values, limits, digits=6):
    got = {}
    for r in rows:
        got.setdefault(tuple(r[k] for k in by), []).append((r.i, r.density))
    assert got.keys() == values.keys()
    for k, v in values.items():
        lo, hi = limits or (min(v), max(v))
        assert [i for i, _ in sorted(got[k])] == list(range(512))
        assert np.allclose([d for _, d in sorted(got[k])], every_kernel(v, lo, hi, digits), rtol=0, atol=1.01 * 10**-digits)


def test_violin_density_sums_every_kernel(spark, tmp_path):
    tax = {s: {0: 0.0, 8: 0.04, 9: 0.06}.get(s // 12, 0.02 + 1e-5 * (s // 12) ** 2 + 1e-6 * s) for s in range(120)}  # narrow kernels
    rows = [(s, t) for s, t in tax.items()]
    spark.createDataFrame(rows, "l_suppkey bigint, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    sets = ["cyto", "topo", "cyto+topo", "trait+height", "cyto+topo+trait", "cyto+trait+topo"]
    values = {}
    for s, t in tax.items():
        if t * 12 <= 0.5:  # the violins' range
            values.setdefault(("trait_n" if s % 12 < 6 else "trait_cwc", sets[s % 6]), []).append(t * 12)
    check_density(QUERIES["violin_density"](spark, str(tmp_path)).collect(), ["yvar", "xvartype"], values, None, 4)


def test_dead_fraction_density_sums_every_kernel(spark, tmp_path):
    def write(name, df):
        df.write.parquet(f"{tmp_path}/{name}.parquet")

    write("customer", spark.range(600).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment")))
    write("orders", spark.range(300).select(F.col("id").alias("o_orderkey")))
    lines = """id % 300 as l_orderkey, id as l_partkey, id as l_suppkey, cast(id % 5 as int) as l_linenumber, 1e0 as l_quantity, 1e2 as l_extendedprice,
        (id % 3) * 0.03e0 as l_discount, 0.05e0 as l_tax, if(id % 4 = 0, 'R', 'N') as l_returnflag,
        make_timestamp_ntz(cast(1997 + id % 5 as int), 3, 1, 0, 0, 0) as l_shipdate"""
    write("lineitem", spark.sql(f"select {lines} from range(900)"))
    sf, values = str(tmp_path), {}
    for r in QUERIES["site_damage_flags"](spark, sf).collect():
        for name in ("damage_survey_years", "damage_lidar"):
            if r[name] is not None:
                values.setdefault((name, int(r[name])), []).append(r.site_code % 12 / 11)
    assert len(values) >= 3
    check_density(QUERIES["dead_fraction_density"](spark, sf).collect(), ["variable", "damage"], values, (0, 1))


def test_kde_by_group_sums_every_kernel(spark, tmp_path):
    values = {(g,): [0.0, 1.0, *(0.5 + step * (k * k % 59) for k in range(1, 58))] for g, step in (("view", 3.7e-5), ("click", 9.17e-5))}
    rows = [(g, 100 * x) for (g,), v in values.items() for x in v] + [("view", 250.0), ("click", None)]
    spark.createDataFrame(rows, "event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    check_density(QUERIES["kde_by_group"](spark, str(tmp_path)).collect(), ["event_type"], values, (0, 1))


def test_violin_spans_each_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 9.0), ("b", 10.0)], "g string, v double")
    median, dens = D.violin(df, "v", ["g"], points=16)
    assert {(r.g, r.median) for r in median.collect()} == {("a", 2.0), ("b", 9.5)}
    span = {r.g: (r.lo, r.hi) for r in dens.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    assert span == {"a": (1.0, 4.0), "b": (9.0, 10.0)}


def test_bad_bands(spark):
    bands = spark.range(1, 427).filter(SP.bad_band(F.col("id"))).agg(F.count("*"), F.min("id"), F.max("id")).first()
    assert tuple(bands) == (76, 1, 426)


def test_wide_and_array_spectra_agree(spark):
    wide = spark.createDataFrame([("d", 100.0, 200.0), ("t", 300.0, None)], "k string, `W400.5` double, `W405` double")
    a = SP.wide_to_bands(wide, ["k"]).collect()
    arr = wide.select("k", F.array("`W400.5`", "W405").alias("refl"))
    b = SP.to_bands(arr, ["k"], [400.5, 405.0], bad=[]).collect()
    key = lambda rows: sorted(repr((r.k, r.wavelength, r.reflectance)) for r in rows)
    assert key(a) == key(b)
    s = {(r.wavelength, r.k): r.m for r in SP.spectral_summary(SP.wide_to_bands(wide, ["k"]), "k").collect()}
    assert s[(405.0, "t")] is None and s[(400.5, "t")] == pytest.approx(0.03)


def test_contingency_refuses_a_continuous_column(spark):
    df = spark.range(1500).select((F.col("id") / 7).alias("a"), (F.col("id") % 2).alias("b"))
    with pytest.raises(Exception, match="more than 1000 levels"):
        T.contingency(df, "a", "b").collect()
    assert T.contingency(df.filter("a < 0"), "a", "b").count() == 0
