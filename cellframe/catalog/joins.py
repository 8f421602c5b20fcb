"""Joins with sites, points, index lists and block lists; parameter grids."""

from pyspark.sql import functions as F

from cellframe.catalog.base import (
    CYTOTYPE_SQL,
    FULL_SQL,
    SPATIAL_BLOCK,
    ctes,
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
)
from cellframe.functions import algebra as A
from cellframe.operators import extract as X
from cellframe.operators import sampling as M
from cellframe.operators import spatial_blocks as SB
from cellframe.operators import stack as S
from cellframe.operators.density import density
from cellframe.plans import forests as FO
from cellframe.plans import layers as L
from cellframe.spark import settle


@query(
    ctes("spectra", "sites")
    + """ select vec_id, s.site_code, label, ploidy, dead from spectra s left join sites t on t.site_code = s.site_code"""
)
def sites_left_join(spark, sf):
    spectra = view(spark, sf, "spectra").select("vec_id", "site_code", "label")
    return X.join_sites(spectra, view(spark, sf, "sites").select("site_code", "ploidy", "dead"))


_AT_SQL = """spot as (
      select site_code, dead, ploidy, x, y, cast(floor((45e5 - y) / 10) as bigint) as r,
        cast(floor((x - 320000) / 10) as bigint) as c from sites)"""


@query(
    ctes("cells", "attrs", "sites")
    + f""", {_AT_SQL}
    select site_code, c.cell_id, {sql_r6("elev", "dh")}, first_year
    from spot left join cells c on c.r = spot.r and c.c = spot.c left join attrs a on a.cell_id = c.cell_id"""
)
def point_extract(spark, sf):
    layers = full_cells(spark, sf)
    out = X.extract_values(
        view(spark, sf, "sites"), layers, grid_for(spark, sf), ["cell_id", "elev", "dh", "first_year"]
    )
    return rounded(out.select("site_code", "cell_id", "elev", "dh", "first_year"), "elev", "dh")


def _site_damage(spark, sf, years=(1998, 2001)):
    g = grid_for(spark, sf)
    yearly = view(spark, sf, "damage_year").filter(F.col("year").between(*years)).withColumn("value", F.lit(1.0))
    composites = S.composite(yearly, ["cell_id"]).withColumns({"r": g.row_of(), "c": g.col_of()})
    heights = view(spark, sf, "attrs").select(g.row_of().alias("r"), g.col_of().alias("c"), "dh")
    return L.site_damage(view(spark, sf, "sites"), composites, heights, g)


_SITE_DAMAGE_SQL = f"""{_AT_SQL},
    yc as (select cell_id, cast(count(*) as double) as n_years from damage_year where year between 1998 and 2001 group by cell_id),
    sd as (
      select site_code, dead, ploidy, case when spot.r is not null and spot.c is not null then coalesce(n_years, 0) end as damage_survey_years,
        coalesce(n_years, 0) > 0 as damage_survey,
        case when dh >= -1e2 then dh < -3 end as damage_lidar
      from spot left join yc on yc.cell_id = spot.r * 100 + spot.c + 1 left join attrs a on a.cell_id = spot.r * 100 + spot.c + 1)"""


@query(
    ctes("attrs", "damage_year", "sites")
    + f", {_SITE_DAMAGE_SQL} select site_code, damage_survey_years, damage_survey, damage_lidar from sd"
)
def site_damage_flags(spark, sf):
    return _site_damage(spark, sf).select("site_code", "damage_survey_years", "damage_survey", "damage_lidar")


@query(
    ctes("attrs", "damage_year", "sites")
    + f""", {_SITE_DAMAGE_SQL},
    f as (select 'damage_survey_years' as variable, cast(damage_survey_years as int) as damage, dead / 11e0 as v from sd
      union all select 'damage_lidar', cast(damage_lidar as int), dead / 11e0 from sd),
    d as (select variable, damage, v from f where damage is not null and v between 0 and 1),
    q as (select variable, damage, count(*) as n, stddev_samp(v) as sd, quantile_cont(v, 25e-2) as q1,
        quantile_cont(v, 75e-2) as q3, min(v) as lo from d group by 1, 2),
    bw as (select variable, damage, n, 9e-1 * coalesce(nullif(least(sd, (q3 - q1) / 134e-2), 0), nullif(sd, 0),
        nullif(abs(lo), 0), 1) * power(n, -2e-1) as bw from q),
    g as (select cast(unnest(range(0, 512)) as int) as i),
    k as (select variable, damage, v, count(*) as k from d group by 1, 2, 3)
    select k.variable, k.damage, i, round(i / 511e0, 6) + 0e0 as x,
      round(sum(k * exp(-5e-1 * power((i / 511e0 - v) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6) + 0e0
        as density
    from k join bw on bw.variable = k.variable and bw.damage = k.damage cross join g group by k.variable, k.damage, i"""
)
def dead_fraction_density(spark, sf):
    flags = _site_damage(spark, sf).select(
        "site_code",
        (F.col("dead") / F.lit(11.0)).alias("dead_fraction"),
        F.col("damage_survey_years").cast("int").alias("damage_survey_years"),
        F.col("damage_lidar").cast("int").alias("damage_lidar"),
    )
    long = flags.unpivot(
        ["site_code", "dead_fraction"], ["damage_survey_years", "damage_lidar"], "variable", "damage"
    ).dropna()
    return rounded(density(settle(long), "dead_fraction", ["variable", "damage"]), "x", "density")


@query(
    ctes("cells", "attrs")
    + f", {FULL_SQL} select cell_id, {sql_r6('elev', 'height')} from full_cells where {CYTOTYPE_SQL} is not null"
)
def cells_by_index(spark, sf):
    cyto = L.cytotype(F.col("cyto_raw"), F.col("cover"), F.col("shade"))
    index = full_cells(spark, sf).filter(A.presence(cyto)).select("cell_id")
    cells = view(spark, sf, "cells").select("cell_id", "elev", "height")
    return rounded(X.cells_by_index(cells, index), "elev", "height")


@query(
    ctes("cells", "damage_year")
    + """, b as (select cell_id, cast((r - r % 20) / 20 * 5 + (c - c % 20) / 20 as bigint) as grid_id from cells),
    hit as (select distinct grid_id from b join damage_year d on d.cell_id = b.cell_id and d.year = 1996)
    select grid_id, case when grid_id in (select grid_id from hit) then 'train' else 'test' end as part, count(*) as n_cells
    from b group by 1, 2"""
)
def block_semi_anti(spark, sf):
    block = F.floor(F.col("r") / 20) * 5 + F.floor(F.col("c") / 20)
    cells = view(spark, sf, "cells").select("cell_id", block.alias("grid_id"))
    hit = cells.join(view(spark, sf, "damage_year").filter("year = 1996"), "cell_id").select("grid_id").distinct()
    train = X.cells_by_index(cells, hit, "grid_id").withColumn("part", F.lit("train"))
    test = X.cells_not_in(cells, hit, "grid_id").withColumn("part", F.lit("test"))
    return S.union_all([train, test]).groupBy("grid_id", "part").agg(F.count(F.lit(1)).alias("n_cells"))


@query(
    ctes("cells", "damage_year")
    + """, b as (select distinct cast((r - r % 20) / 20 * 5 + (c - c % 20) / 20 as bigint) as grid_id from cells)
    select grid_id from b except select cast((r - r % 20) / 20 * 5 + (c - c % 20) / 20 as bigint) from cells c
    join damage_year d on d.cell_id = c.cell_id where d.year = 1996 and c.cover = 0 and c.height > 27"""
)
def block_difference(spark, sf):
    block = F.floor(F.col("r") / 20) * 5 + F.floor(F.col("c") / 20)
    cells = view(spark, sf, "cells").withColumn("grid_id", block)
    hit = cells.filter("cover = 0 AND height > 27").join(
        view(spark, sf, "damage_year").filter("year = 1996"), "cell_id"
    )
    return SB.block_lists(cells.select("grid_id").distinct(), hit.select("grid_id").distinct())


@query(
    model_ctes()
    + """, g(i, name) as (values (1, 'cyto'), (2, 'topo'), (3, 'trait'), (4, 'height')),
    sets as (select x, k, row_number() over (order by k, x) as pos from (
      select string_agg(name, '+' order by i) as x, count(*) as k, min(m) as m
        from (select m from (select unnest(range(1, 16)) as m) t) s join g on (m >> (i - 1)) & 1 = 1 group by s.m) u),
    ordered as (select x, row_number() over (order by k,
        case when x like 'cyto%' then 1 when x like 'topo%' then 2 when x like 'trait%' then 3 else 4 end,
        case when x like '%+topo%' then 1 when x like '%+trait%' then 2 else 3 end,
        case when x like '%+trait%' then 1 else 2 end) - 1 as sx from sets where x not like '%trait%'),
    y(sy, yvar) as (values (0, 'trait_d13c'), (1, 'trait_n'), (2, 'trait_cwc')),
    np as (select count(*) as np from model where cover_fraction > 5e-1)
    select cast(sy * 35 + (it - 1) * 7 + sx + 1 as int) as run_id, x as xvartype, cast(it as int) as iter, yvar, np
    from ordered cross join (select unnest(range(1, 6)) as it) i cross join y cross join np"""
)
def param_grid(spark, sf):
    frame = FO.modelling_frame(modelling(spark, sf), SPATIAL_BLOCK)
    sizes = frame.agg(F.count(F.lit(1)).alias("np"))
    sets = FO.predictor_sets(without=["trait"])
    return FO.parameter_grid(sizes, sets, range(1, 6), ["trait_d13c", "trait_n", "trait_cwc"])


@query(
    ctes("sites")
    + """ select site_code, lower(ploidy) as ploidy, """
    + sql_r6("x", "y")
    + " from sites where x between 320300 and 320700 and y between 4499600 and 4500000"
)
def ground_points_inset(spark, sf):
    inside = X.in_window(view(spark, sf, "sites"), "x", "y", 320500.0, 4499800.0, 200.0)
    return inside.select("site_code", F.lower("ploidy").alias("ploidy"), r6("x").alias("x"), r6("y").alias("y"))


@query(
    ctes("cells", "attrs")
    + f""", {FULL_SQL},
    k as (select greatest(1, cast(ceil(sqrt(least(60, ceil(count(*) / 1e2)) * 60 / 1e3)) as bigint)) as k from cells),
    m as (select 320000 + (c + 5e-1) * 10 as x, 45e5 - (r + 5e-1) * 10 as y, {CYTOTYPE_SQL} as cytotype,
        case when dh >= -1e2 then case when dh < -3 then 1e0 else 0e0 end end as lidar, height
      from full_cells cross join k where r between 0 and 59 and c between 20 and 79 and r % k = 0 and (c - 20) % k = 0)
    select x, y, 'damage_lidar' as variable, case when cytotype is not null then lidar end as value from m
    union all select x, y, 'height', case when cytotype is not null then round(height, 6) + 0e0 end from m"""
)
def map_extract_inset(spark, sf):
    cells, g = grid_for(spark, sf).cropped(full_cells(spark, sf), 320200, 320800, 4499400, 4500000)
    cyto = L.cytotype(F.col("cyto_raw"), F.col("cover"), F.col("shade"))
    df = cells.select(
        "r",
        "c",
        A.keep_where(L.height_damage(F.col("dh")), cyto).alias("damage_lidar"),
        A.keep_where(F.col("height"), cyto).alias("height"),
    )
    long = S.to_long(df, ["damage_lidar", "height"]).withColumnRenamed("layer", "variable")
    return M.stride_sample(long, g, 1000).select("x", "y", "variable", r6("value").alias("value"))


@query(
    """select r_name as region, replace(n_name, 'NATION_', 'N') as name, count(c_custkey) as n_customers
    from nation join region on r_regionkey = n_regionkey left join customer on c_nationkey = n_nationkey
    where r_regionkey in (0, 2, 3) and n_name not in ('NATION_2', 'NATION_3') group by 1, 2"""
)
def gazetteer_labels(spark, sf):
    places = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    picked = places.filter(F.col("r_regionkey").isin(0, 2, 3) & ~F.col("n_name").isin("NATION_2", "NATION_3"))
    named = picked.withColumn("name", F.regexp_replace("n_name", "NATION_", "N"))
    customers = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("k"))
    return named.join(customers, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("r_name").alias("region"), "name", F.coalesce("k", F.lit(0).cast("bigint")).alias("n_customers")
    )
