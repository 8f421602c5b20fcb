"""Spectra, confusion tables and densities."""

from pyspark.sql import functions as F

from cellframe.catalog.base import BAD, BAND_STEP, FIRST_BAND, ctes, query, r6, rounded, sql_r6, table, view
from cellframe.catalog.joins import _SITE_DAMAGE_SQL, _site_damage
from cellframe.operators import confusion as C
from cellframe.operators import density as D
from cellframe.operators import extract as X
from cellframe.operators import spectra as SP

_LONG_SQL = """long as (
      select vec_id, site_code, label, cast(b as int) as band, 380e0 + 5 * b as wavelength,
        case when not (b between 1 and 3 or b between 30 and 33 or b between 62 and 64)
          then cast(refl[b] as double) / 1e4 end as reflectance
      from spectra cross join (select unnest(range(1, 65)) as b) n where shade = 1 and cover = 0)"""


def _long(spark, sf, *keep):
    usable = view(spark, sf, "spectra").filter("shade = 1 AND cover = 0")
    wavelength = F.lit(FIRST_BAND) + F.lit(BAND_STEP) * F.col("band")
    return SP.to_bands(usable, keep, wavelength, "refl", SP.REFLECTANCE_SCALE, BAD)


@query(
    ctes("spectra") + f", {_LONG_SQL} select vec_id, band, wavelength, round(reflectance, 9) + 0e0 as reflectance from long"
)
def spectra_long(spark, sf):
    return _long(spark, sf, "vec_id").withColumn("reflectance", r6("reflectance", 9))


def _summary_sql(by: str) -> str:
    return f"""
    select wavelength, {by}, policy, round(m, 9) + 0e0 as m, round(s, 9) + 0e0 as s,
      round(m - s, 9) + 0e0 as lower, round(m + s, 9) + 0e0 as upper
    from (
      select wavelength, {by}, 'skip' as policy, avg(reflectance) as m, stddev_samp(reflectance) as s from d group by 1, 2
      union all
      select wavelength, {by}, 'propagate', case when count(*) = count(reflectance) then avg(reflectance) end,
        case when count(*) = count(reflectance) then stddev_samp(reflectance) end from d group by 1, 2) t"""


def _both(long, by, exclude=()):
    out = SP.spectral_summary(long, by, ("skip", "propagate"), exclude)
    return out.withColumns({n: r6(n, 9) for n in ("m", "s", "lower", "upper")})


@query(
    ctes("spectra")
    + f", {_LONG_SQL}, d as (select vec_id, wavelength, label, case when vec_id % 31 = 0 and band = 7 then null else "
    + "reflectance end as reflectance from long)"
    + _summary_sql("label")
)
def spectra_by_class(spark, sf):
    long = _long(spark, sf, "vec_id", "label")
    gap = (F.col("vec_id") % 31 == 0) & (F.col("band") == 7)  # an incomplete band for the two policies to differ on
    return _both(long.withColumn("reflectance", F.when(~gap, F.col("reflectance"))), "label")


@query(
    ctes("spectra", "sites")
    + f""", {_LONG_SQL}, d as (select wavelength, ploidy as cytotype, reflectance
      from long left join sites using (site_code) where ploidy is not null and ploidy not in ('nan', ''))"""
    + _summary_sql("cytotype")
)
def spectra_by_cytotype(spark, sf):
    usable = view(spark, sf, "spectra").filter("shade = 1 AND cover = 0")
    sites = view(spark, sf, "sites").select("site_code", F.col("ploidy").alias("cytotype"))
    wavelength = F.lit(FIRST_BAND) + F.lit(BAND_STEP) * F.col("band")
    long = SP.to_bands(X.join_sites(usable, sites), ["cytotype"], wavelength, "refl", SP.REFLECTANCE_SCALE, BAD)
    return _both(long, "cytotype", ["nan", ""])


_ANY_DAMAGE_SQL = _SITE_DAMAGE_SQL.replace(" where year between 1998 and 2001", "")


@query(
    ctes("spectra", "sites", "attrs", "damage_year")
    + f""", {_LONG_SQL}, {_ANY_DAMAGE_SQL}, d as (select wavelength, damage_survey, reflectance
      from long left join sd using (site_code) where damage_survey is not null)"""
    + _summary_sql("damage_survey")
)
def spectra_by_damage(spark, sf):
    usable = view(spark, sf, "spectra").filter("shade = 1 AND cover = 0")
    sites = _site_damage(spark, sf, (1995, 2001)).select("site_code", "damage_survey")  # any year of the composite
    wavelength = F.lit(FIRST_BAND) + F.lit(BAND_STEP) * F.col("band")
    long = SP.to_bands(X.join_sites(usable, sites), ["damage_survey"], wavelength, "refl", SP.REFLECTANCE_SCALE, BAD)
    return _both(long, "damage_survey")


_RATES_SQL = {
    "sensitivity": "tp / nullif(tp + fn, 0)",
    "specificity": "tn / nullif(tn + fp, 0)",
    "pos_pred_value": "tp / nullif(tp + fp, 0)",
    "neg_pred_value": "tn / nullif(tn + fn, 0)",
    "precision": "tp / nullif(tp + fp, 0)",
    "recall": "tp / nullif(tp + fn, 0)",
    "f1": "2 * tp / nullif(2 * tp + fp + fn, 0)",
    "prevalence": "(tp + fn) / nullif(tp + tn + fp + fn, 0)",
    "detection_rate": "tp / nullif(tp + tn + fp + fn, 0)",
    "detection_prevalence": "(tp + fp) / nullif(tp + tn + fp + fn, 0)",
    "balanced_accuracy": "(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2",
    "accuracy": "(tp + tn) / nullif(tp + tn + fp + fn, 0)",
}


@query(
    """with k as (select count(*) filter (toxic = 1 and quality = 1) as tp, count(*) filter (toxic <> 1 and quality <> 1) as tn,
      count(*) filter (toxic = 1 and quality <> 1) as fp, count(*) filter (toxic <> 1 and quality = 1) as fn from labels)
    select tp, tn, fp, fn, """
    + sql_r6(*[f"{e} as {n}" for n, e in _RATES_SQL.items()])
    + " from k"
)
def confusion_binary(spark, sf):
    pairs = C.from_pairs(table(spark, sf, "labels"), "quality", "toxic")
    return rounded(C.rates(C.one_vs_rest(pairs, F.lit(1))), *_RATES_SQL)


@query(
    """with t(observed, predicted, value) as (
      select 'triploid', 'triploid', count(*) filter (quality = 1 and toxic = 1) from labels union all
      select 'triploid', 'diploid', count(*) filter (quality = 1 and toxic = 0) from labels union all
      select 'diploid', 'triploid', count(*) filter (quality = 0 and toxic = 1) from labels union all
      select 'diploid', 'diploid', count(*) filter (quality = 0 and toxic = 0) from labels)
    select * from t"""
)
def confusion_tidy(spark, sf):
    name = F.when(F.col("toxic") == 1, "predicted triploid").otherwise("predicted diploid")
    matrix = (
        table(spark, sf, "labels")
        .groupBy(name.alias("X"))
        .agg(
            F.count_if(F.col("quality") == 1).alias("observed.triploid"),
            F.count_if(F.col("quality") == 0).alias("observed.diploid"),
        )
    )
    return C.tidy_crosstab(matrix, "X", [F.col("`observed.triploid`"), F.col("`observed.diploid`")])


_KDE_SQL = """
    q as (select g, count(*) as n, stddev_samp(v) as sd, quantile_cont(v, 25e-2) as q1, quantile_cont(v, 75e-2) as q3,
        min(v) as lo from d group by g),
    bw as (select g, n, 9e-1 * coalesce(nullif(least(sd, (q3 - q1) / 134e-2), 0), nullif(sd, 0), nullif(abs(lo), 0), 1)
        * power(n, -2e-1) as bw from q),
    k as (select g, v, count(*) as k from d group by 1, 2)"""


@query(
    f"""with d as (select event_type as g, value / 1e2 as v from events where value / 1e2 between 0 and 1), {_KDE_SQL}
    select k.g as event_type, cast(i as int) as i, round(i / 511e0, 6) + 0e0 as x,
      round(sum(k * exp(-5e-1 * power((i / 511e0 - v) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6) + 0e0
        as density
    from k join bw on bw.g = k.g cross join (select unnest(range(0, 512)) as i) n group by k.g, i"""
)
def kde_by_group(spark, sf):
    df = table(spark, sf, "events").select("event_type", (F.col("value") / 100.0).alias("v"))
    return rounded(D.density(df, "v", ["event_type"]), "x", "density")
