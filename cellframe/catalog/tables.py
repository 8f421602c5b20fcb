"""Binned areas, prevalence, contingency, spatial blocks and samples."""

from pyspark.sql import functions as F

from cellframe.catalog.base import (
    BLOCK,
    SPATIAL_BLOCK,
    TILE,
    full_cells,
    grid_for,
    model_ctes,
    modelling,
    query,
    r6,
    rounded,
    sql_r6,
    table,
    view,
    ctes,
)
from cellframe.catalog.composites import COMPLETE_SQL, TRIM, _quantile_sql
from cellframe.functions import algebra as A
from cellframe.functions import binning
from cellframe.operators import quantiles as Q
from cellframe.operators import sampling as M
from cellframe.operators import spatial_blocks as SB
from cellframe.operators import tables as T
from cellframe.operators.stack import union_all
from cellframe.plans import forests as FO
from cellframe.plans import layers as L
from cellframe.plans import partial_dependence as PD
from cellframe.plans.forests import modelling_frame
from cellframe.spark import settle


def _sql_bin(col: str, breaks: list[float]) -> str:
    n = " + ".join(f"case when {col} > {b}::double then 1 else 0 end" for b in breaks)
    cases = " ".join(f"when {i} then '({a:.10g},{b:.10g}]'" for i, (a, b) in enumerate(zip(breaks, breaks[1:]), 1))
    return f"case {n} {cases} end"


SQL_LABEL = "case when diploid_fraction > 5e-1 then 'diploid' when diploid_fraction is not null then 'triploid' end"


def _area_sql(col: str, breaks: list[float]) -> str:
    return model_ctes() + (
        f" select {SQL_LABEL} as cytotype, {_sql_bin(col, breaks)} as bin, count(*) as n_cells,"
        " count(*) * 25e2 as area_m2 from model group by 1, 2"
    )


def _area(spark, sf, col, breaks):
    df = modelling(spark, sf).select(
        A.recode_threshold(F.col("diploid_fraction"), 0.5, "diploid", "triploid").alias("cytotype"),
        binning.bin_label(F.col(col), breaks).alias("bin"),
    )
    area = grid_for(spark, sf).coarsen(BLOCK).cell_area
    return T.grouped_count(df, ["cytotype", "bin"], "n_cells").withColumn("area_m2", F.col("n_cells") * F.lit(area))


@query(_area_sql("elevation", binning.ELEVATION_BREAKS))
def area_by_bin_elev(spark, sf):
    return _area(spark, sf, "elevation", binning.ELEVATION_BREAKS)


@query(_area_sql("slope", binning.SLOPE_BREAKS))
def area_by_bin_slope(spark, sf):
    return _area(spark, sf, "slope", binning.SLOPE_BREAKS)


@query(_area_sql("cos_aspect", binning.COS_ASPECT_BREAKS))
def area_by_bin_cosaspect(spark, sf):
    return _area(spark, sf, "cos_aspect", binning.COS_ASPECT_BREAKS)


# prevalence ---------------------------------------------------------------------------


def _trimmed_sql() -> str:
    frame = f"frame as (select * from model where cover_fraction > 5e-1 and {COMPLETE_SQL})"
    cond = " and ".join(
        f"{c} > {_quantile_sql(c, '1e-2', 'frame')} and {c} < {_quantile_sql(c, '99e-2', 'frame')}" for c in TRIM
    )
    return frame + f",\n trimmed as (select * from frame where {cond})"


def _sql_lower(col: str, lo: str, hi: str) -> str:
    edges = [lo] + [f"{lo} + {i} * (({hi} - {lo}) / 9e0)" for i in range(1, 9)] + [hi]
    n = " + ".join(f"case when {col} > {e} then 1 else 0 end" for e in edges)
    cases = " ".join(f"when {i} then {e}" for i, e in enumerate(edges[:-1], 1))
    return f"case {n} {cases} end"


def _prevalence_sql(x: str, y: str, label: bool) -> str:
    span = f"s as (select min({x}) as x0, max({x}) as x1, min({y}) as y0, max({y}) as y1 from trimmed)"
    by = f"{SQL_LABEL} as cytotype, " if label else ""
    group = "1, 2, 3" if label else "1, 2"
    return model_ctes(_trimmed_sql(), span) + (
        f", g as (select {by}{_sql_lower(x, 'x0', 'x1')} as {x}_bin, {_sql_lower(y, 'y0', 'y1')} as {y}_bin,"
        f" count(*) as n from model cross join s group by {group})"
        f" select {'cytotype, ' if label else ''}{sql_r6(f'{x}_bin', f'{y}_bin')}, n,"
        " round(sqrt(n / sum(n) over ()), 6) + 0e0 as sqrt_share from g"
    )


def _prevalence(spark, sf, x, y, label):
    df = settle(modelling(spark, sf))  # read three times; float means must be the same each time
    by = []
    if label:
        df = df.withColumn("cytotype", A.recode_threshold(F.col("diploid_fraction"), 0.5, "diploid", "triploid"))
        by = ["cytotype"]
    trimmed = FO.training_frame(df, reread=True)
    return rounded(PD.prevalence(df, trimmed, x, y, by), f"{x}_bin", f"{y}_bin", "sqrt_share")


@query(_prevalence_sql("elevation", "trait_cwc", True))
def prevalence_2d(spark, sf):
    return _prevalence(spark, sf, "elevation", "trait_cwc", True)


@query(_prevalence_sql("cos_aspect", "height", True))
def prevalence_2d_traits(spark, sf):
    return _prevalence(spark, sf, "cos_aspect", "height", True)


@query(_prevalence_sql("elevation", "trait_cwc", False))
def prevalence_2d_all(spark, sf):
    return _prevalence(spark, sf, "elevation", "trait_cwc", False)


# contingency --------------------------------------------------------------------------

_PAIRS_SQL = (
    "pairs as (select diploid_fraction as a, damage_survey as b from stack"
    " where diploid_fraction is not null and damage_survey is not null)"
)
_TABLE_SQL = (
    "tab as (select l.a, m.b, count(p.a) as freq from (select distinct a from pairs) l"
    " cross join (select distinct b from pairs) m left join pairs p on p.a = l.a and p.b = m.b group by l.a, m.b)"
)


def _damage_table(spark, sf, damage="damage_survey"):
    stack = L.layer_stack(full_cells(spark, sf), grid_for(spark, sf), BLOCK, TILE)
    return T.contingency(stack, "diploid_fraction", damage)


@query(
    model_ctes(_PAIRS_SQL, _TABLE_SQL)
    + """ select a as diploid_fraction, b as damage_survey, freq,
      round(freq / sum(freq) over (partition by b), 6) + 0e0 as share,
      cast(sum(freq) over (partition by b) as bigint) as n_cells from tab"""
)
def contingency_fraction(spark, sf):
    shares = T.with_share(_damage_table(spark, sf), "damage_survey")
    return rounded(shares.join(T.totals(shares, "damage_survey"), "damage_survey"), "share")


@query(
    model_ctes(_PAIRS_SQL, _TABLE_SQL)
    + """, e as (select freq as o, sum(freq) over (partition by a) * sum(freq) over (partition by b)
        / cast(sum(freq) over () as double) as e, sum(freq) over () as n from tab)
    select cast(max(n) as bigint) as n, cast(1 as bigint) as df,
      round(sum(power(abs(o - e) - least(5e-1, (select min(abs(o - e)) from e)), 2) / e), 6) + 0e0 as statistic from e"""
)
def chisq_corrected(spark, sf):
    return rounded(T.chi_square(_damage_table(spark, sf), "diploid_fraction", "damage_survey"), "statistic")


def _test_sql(damage: str) -> str:
    """Statistic with the continuity correction of a 2x2 table, and the gamma series for its tail."""
    return f"""(with p as (select diploid_fraction as a, {damage} as b from stack where diploid_fraction is not null and {damage} is not null),
      t as (select l.a, m.b, count(p.a) as freq from (select distinct a from p) l cross join (select distinct b from p) m
        left join p on p.a = l.a and p.b = m.b group by l.a, m.b),
      e as (select freq as o, sum(freq) over (partition by a) * sum(freq) over (partition by b) / cast(sum(freq) over () as double) as e,
        sum(freq) over () as n, a, b from t),
      s as (select cast(max(n) as bigint) as n, cast((count(distinct a) - 1) * (count(distinct b) - 1) as bigint) as df,
        sum(power(abs(o - e) - case when cells = 4 then least(5e-1, m) else 0 end, 2) / e) as x
        from (select *, min(abs(o - e)) over () as m, count(*) over () as cells from e) q)
      select '{damage}' as variable, n, df, round(x, 6) + 0e0 as statistic,
        round(1 - (select sum(exp((df / 2e0 + i) * ln(x / 2) - x / 2 - lgamma(df / 2e0 + i + 1))) from (select unnest(range(0, 2000)) as i) r), 9) + 0e0 as p_value
      from s)"""


@query(model_ctes() + f" select * from {_test_sql('damage_survey')} u union all select * from {_test_sql('damage_lidar')} v")
def chisq_tests(spark, sf):
    """Cytotype against damage, of the survey and of height change, with p-values."""
    tests = [
        T.chi_square_test(_damage_table(spark, sf, d), "diploid_fraction", d).withColumn("variable", F.lit(d)) for d in ("damage_survey", "damage_lidar")
    ]
    return rounded(union_all(tests), "statistic").withColumn("p_value", r6("p_value", 9))


_LIDAR_SQL = _PAIRS_SQL.replace("damage_survey", "damage_lidar")


@query(
    model_ctes(_LIDAR_SQL, _TABLE_SQL)
    + """ select a as diploid_fraction, b as damage_lidar, freq,
      round(freq / sum(freq) over (partition by b), 6) + 0e0 as share,
      cast(sum(freq) over (partition by b) as bigint) as n_cells from tab"""
)
def contingency_lidar(spark, sf):
    shares = T.with_share(_damage_table(spark, sf, "damage_lidar"), "damage_lidar")
    return rounded(shares.join(T.totals(shares, "damage_lidar"), "damage_lidar"), "share")


# spatial blocks and samples -----------------------------------------------------------

_BLOCK_SQL = """
    xy as (select cell_id, 320000 + (c + 5e-1) * 10 as x, 45e5 - (r + 5e-1) * 10 as y from {source}),
    span as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from xy),
    k as (select cell_id, x0, y0,
        case when ceil((x - x0) / 2e2) between 1 and floor((x1 - x0) / 2e2) then ceil((x - x0) / 2e2) end as kx,
        case when ceil((y - y0) / 2e2) between 1 and floor((y1 - y0) / 2e2) then ceil((y - y0) / 2e2) end as ky
      from xy cross join span),
    lab as (select cell_id,
        coalesce(printf('(%.2f,%.2f]', x0 + (kx - 1) * 2e2, x0 + kx * 2e2), 'NA') as x_grid,
        coalesce(printf('(%.2f,%.2f]', y0 + (ky - 1) * 2e2, y0 + ky * 2e2), 'NA') as y_grid from k),
    ids as (select cell_id, x_grid, y_grid, dense_rank() over (order by x_grid, y_grid) as grid_id from lab)"""


def _blocks_sql(source: str) -> str:
    return _BLOCK_SQL.format(source=source)


@query(ctes("cells") + "," + _blocks_sql("cells") + " select cell_id, x_grid, y_grid, grid_id from ids")
def spatial_blocks(spark, sf):
    cells = grid_for(spark, sf).with_xy(view(spark, sf, "cells"))
    return SB.with_block_ids(cells, SPATIAL_BLOCK).select("cell_id", "x_grid", "y_grid", "grid_id")


@query(
    ctes("cells")
    + ","
    + _blocks_sql("cells")
    + """, kept as (select i.cell_id, i.grid_id from ids i join cells c on c.cell_id = i.cell_id where c.cover = 0),
    hashed as (select id, row_number() over (order by md5(concat(id, ':7'))) as k, count(*) over () as n
      from (select unnest(range(1, (select max(grid_id) from kept) + 1)) as id) t)
    select cell_id, grid_id, case when exists (select 1 from hashed where id = grid_id and k <= floor(8e-1 * n))
      then 'train' else 'test' end as part from kept"""
)
def block_split(spark, sf):
    cells = grid_for(spark, sf).with_xy(view(spark, sf, "cells"))
    kept = SB.with_block_ids(cells, SPATIAL_BLOCK).filter("cover = 0").select("cell_id", "grid_id")
    train, test = SB.split_blocks(kept, 0.8, 7)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    model_ctes()
    + """, m as (select 1 + r * 20 + c as id, cover_fraction, damage_lidar, damage_survey from model)
    select id as cell_id, """
    + sql_r6("cover_fraction", "case when damage_lidar is not null then damage_survey end as damage_survey_clipped")
    + " from m where cover_fraction > 5e-1"
)
def modelling_rows(spark, sf):
    frame = modelling_frame(modelling(spark, sf), SPATIAL_BLOCK)
    return rounded(
        frame.select("cell_id", "cover_fraction", "damage_survey_clipped"), "cover_fraction", "damage_survey_clipped"
    )


@query("select o_orderkey from (select o_orderkey from orders order by md5(concat(o_orderkey, ':1')) limit 1000) t")
def sample_uniform_md5(spark, sf):
    return M.sample_rows(table(spark, sf, "orders"), "o_orderkey", 1000, 1).select("o_orderkey")


@query(
    ctes("attrs")
    + """, a as (select cell_id, case when cyto_raw > 5e-1 then 1 else 0 end as label from attrs where cyto_raw >= 0),
    s as (select min(n) as smallest, count(*) as classes from (select count(*) as n from a group by label) t),
    o as (select *, row_number() over (partition by label order by md5(concat(cell_id, ':3'))) as k from a)
    select cell_id, label from o cross join s where k <= floor(smallest / classes)"""
)
def sample_balanced_md5(spark, sf):
    a = view(spark, sf, "attrs").filter("cyto_raw >= 0")
    labelled = a.select("cell_id", A.above(F.col("cyto_raw"), 0.5).cast("int").alias("label"))
    return M.sample_balanced(settle(labelled), "cell_id", "label", 3)


@query(
    ctes("attrs")
    + """ select min(n) as n_min from (select count(*) as n from attrs where cyto_raw >= 0 group by cyto_raw > 5e-1) t"""
)
def smallest_class(spark, sf):
    a = view(spark, sf, "attrs").filter("cyto_raw >= 0")
    return T.smallest_class(a.select((F.col("cyto_raw") > 0.5).alias("label")), "label")


@query(
    ctes("cells")
    + """, k as (select greatest(1, cast(ceil(sqrt(cast(ceil(count(*) / 1e2) * 100 as double) / 2000)) as bigint)) as k from cells)
    select 320000 + (c + 5e-1) * 10 as x, 45e5 - (r + 5e-1) * 10 as y, round(height, 6) + 0e0 as value
    from cells cross join k where r % k = 0 and c % k = 0"""
)
def raster_stride_sample(spark, sf):
    layer = view(spark, sf, "cells").select("r", "c", F.col("height").alias("value"))
    return M.stride_sample(layer, grid_for(spark, sf), 2000).select("x", "y", r6("value").alias("value"))


@query(
    ctes("cells", "attrs")
    + """ select name, p, round(value, 6) + 0e0 as value from (
      select 'height' as name, unnest([1e-2, 99e-2]) as p, unnest(quantile_cont(height, [1e-2, 99e-2])) as value from cells
      union all select 'elev', unnest([1e-2, 99e-2]), unnest(quantile_cont(elev, [1e-2, 99e-2])) from cells
      union all select 'cwc', unnest([1e-2, 99e-2]), unnest(quantile_cont(cwc, [1e-2, 99e-2])) from attrs) t"""
)
def layer_quantiles(spark, sf):
    df = full_cells(spark, sf)
    return rounded(Q.exact_quantiles(df, ["height", "elev", "cwc"], [0.01, 0.99]), "value")
