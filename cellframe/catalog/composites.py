"""Layer algebra, masks and yearly composites."""

from pyspark.sql import functions as F

from cellframe.catalog.base import (
    BLOCK,
    CYTOTYPE_SQL,
    FULL_SQL,
    STACK_SQL,
    TERRAIN_SQL,
    TILE,
    YEARS,
    ctes,
    full_cells,
    grid_for,
    polygons,
    query,
    r6,
    rounded,
    sql_r6,
    view,
)
from cellframe.functions import algebra as A
from cellframe.operators import polygons as P
from cellframe.operators import stack as S
from cellframe.plans import forests as FO
from cellframe.plans import layers as L
from cellframe.sources.readers import normalize_polygons


@query(
    ctes("cells", "damage_year")
    + """
    select year, variable, n_cells, n_cells * 1e2 as area_m2 from (
      select y.year, v.variable, coalesce(count(f.cell_id), 0) as n_cells
      from (select cast(unnest(range(1995, 2002)) as int) as year) y
      cross join (values ('in_cover'), ('out_cover')) v(variable)
      left join (
        select d.cell_id, min(d.year) as year, case when any_value(c.cover) = 0 then 'in_cover' else 'out_cover' end as variable
        from damage_year d join cells c on c.cell_id = d.cell_id where c.elev is not null group by d.cell_id) f
        on f.year = y.year and f.variable = v.variable
      group by y.year, v.variable) t"""
)
def damage_by_year_cover(spark, sf):
    first = S.first_year_damaged(_yearly(spark, sf), ["cell_id"])
    return L.damage_by_year(first, view(spark, sf, "cells"), grid_for(spark, sf), YEARS, ["cell_id"])


def _yearly(spark, sf):
    return view(spark, sf, "damage_year").withColumn("value", F.lit(1.0))


@query(ctes("damage_year") + " select cell_id, cast(count(*) as double) as n_years from damage_year group by cell_id")
def damage_year_count(spark, sf):
    return S.years_damaged(_yearly(spark, sf), ["cell_id"])


@query(ctes("damage_year") + " select cell_id, min(year) as first_year from damage_year group by cell_id")
def damage_first_year(spark, sf):
    return S.first_year_damaged(_yearly(spark, sf), ["cell_id"])


@query(
    ctes("cells", "attrs")
    + " select coalesce(c.cell_id, a.cell_id) as cell_id, "
    + sql_r6("elev", "cast(cover as double) as cover", "cast(shade as double) as shade", "height", "cyto_raw", "dh")
    + " from cells c full join attrs a on a.cell_id = c.cell_id"
)
def stack_layers_wide(spark, sf):
    first, second = ["elev", "cover", "shade", "height"], ["cyto_raw", "dh"]
    wide = S.align([(view(spark, sf, "cells"), first), (view(spark, sf, "attrs"), second)], ["cell_id"])
    return rounded(wide, *first, *second)


@query(ctes("damage_year") + " select year, count(*) as n_cells from damage_year group by year")
def yearly_stack_scan(spark, sf):
    named = _yearly(spark, sf).select(
        F.concat(F.lit("damage_Year."), F.col("year").cast("string")).alias("layer"), "cell_id", "value"
    )
    return S.parse_year(named).groupBy("year").agg(F.count("value").alias("n_cells"))


@query(
    ctes("diamonds")
    + """
    select poly_id, year, host_code, case when year >= 2000 then round(area, 6) end as area
    from diamonds where host_code = 746 and (year < 2001 or area is not null)"""
)
def polys_schema_drift(spark, sf):
    d = polygons(spark, sf)
    old = d.filter("year < 2000").select("poly_id", "year", F.col("host_code").alias("HOST1"), "rings")
    new = d.filter("year >= 2000").select(
        "poly_id", "year", F.col("host_code").alias("HOST_CODE"), F.col("area").alias("Area"), "rings"
    )
    both = S.union_all([normalize_polygons(old), normalize_polygons(new)])
    kept = P.select_host(both, L.HOST_CODE).filter("year < 2001 OR area IS NOT NULL")
    return kept.select("poly_id", "year", "host_code", F.round("area", 6).alias("area"))


@query(ctes("cells", "attrs") + f", {FULL_SQL} select cell_id, {CYTOTYPE_SQL} as cytotype from full_cells")
def mask_threshold_cytotype(spark, sf):
    df = full_cells(spark, sf)
    return df.select("cell_id", L.cytotype(F.col("cyto_raw"), F.col("cover"), F.col("shade")).alias("cytotype"))


@query(
    ctes("cells", "attrs")
    + f""", {FULL_SQL}
    select cell_id,
      round(case when elev is null or trait_n_unc > 15e-2 or trait_n < 0 or trait_n > 10 then null else trait_n end, 6) + 0e0
        as trait_n,
      round(case when elev is null or trait_d13c_unc > 8e-1 or trait_d13c < -30 or trait_d13c > -22 then null
        else trait_d13c end, 6) + 0e0 as trait_d13c
    from full_cells"""
)
def trait_qc(spark, sf):
    elev = F.col("elev")
    return full_cells(spark, sf).select(
        "cell_id",
        *[r6(L.trait(F.col(t), F.col(f"{t}_unc"), t, elev)).alias(t) for t in ("trait_n", "trait_d13c")],
    )


@query(
    ctes("cells", "attrs")
    + f""", {FULL_SQL}
    select cell_id, {CYTOTYPE_SQL} is not null as has_cytotype, first_year is not null as damaged, elev is not null as mapped
    from full_cells"""
)
def presence_indicator(spark, sf):
    domain = grid_for(spark, sf).domain(spark)
    sparse = full_cells(spark, sf).select(
        "cell_id",
        L.cytotype(F.col("cyto_raw"), F.col("cover"), F.col("shade")).alias("cytotype"),
        "first_year",
        "elev",
    )
    return domain.join(sparse, "cell_id", "left").select(
        "cell_id",
        A.presence(F.col("cytotype")).alias("has_cytotype"),
        A.presence(F.col("first_year")).alias("damaged"),
        A.presence(F.col("elev")).alias("mapped"),
    )


@query(
    ctes("cells", "damage_year")
    + """
    select c.cell_id, cast(count(d.year) as double) as n_years, count(d.year) > 0 as damaged
    from cells c left join damage_year d on d.cell_id = c.cell_id and d.year between 1998 and 2001
    group by c.cell_id"""
)
def fill_then_sum_years(spark, sf):
    summed = S.years_damaged(_yearly(spark, sf).filter(F.col("year").between(1998, 2001)), ["cell_id"])
    n = A.fill_null(F.col("n_years"), 0.0)
    domain = grid_for(spark, sf).domain(spark)
    return domain.join(summed, "cell_id", "left").select("cell_id", n.alias("n_years"), (n > 0).alias("damaged"))


@query(
    ctes("cells", "attrs")
    + f""", {FULL_SQL},
    t as (select r, c, {CYTOTYPE_SQL} as cytotype from full_cells),
    b as (select (r - r % 5) / 5 as br, (c - c % 5) / 5 as bc, median(cytotype) as m from t group by 1, 2)
    select r, c, cytotype, coalesce(cytotype, m) as cytotype_filled
    from t join b on b.br = (t.r - t.r % 5) / 5 and b.bc = (t.c - t.c % 5) / 5"""
)
def cover_gapfill_5(spark, sf):
    return L.cytotype_layers(full_cells(spark, sf), 5).select("r", "c", "cytotype", "cytotype_filled")


_HOLES = "cell_id % 7 <> 3 and ((r - r % 5) / 5 + (c - c % 5) / 5) % 9 <> 4"  # single cells and whole blocks are absent


@query(
    ctes("cells", "attrs")
    + f""", {FULL_SQL},
    t as (select r, c, {CYTOTYPE_SQL} as cytotype from full_cells where {_HOLES}),
    b as (select cast((r - r % 5) / 5 as bigint) as br, cast((c - c % 5) / 5 as bigint) as bc, median(cytotype) as m from t group by 1, 2),
    d as (select br * 5 + i as r, bc * 5 + j as c, m from b cross join (select unnest(range(0, 5)) as i) x cross join (select unnest(range(0, 5)) as j) y
      where br * 5 + i < (select ceil(count(*) / 1e2) from cells))
    select d.r, d.c, cytotype, coalesce(cytotype, m) as cytotype_filled from d left join t on t.r = d.r and t.c = d.c"""
)
def cover_gapfill_holes(spark, sf):
    """Gap fill of a cell table with absent cells and absent blocks: cells of blocks with data are all filled."""
    cells = full_cells(spark, sf).filter(_HOLES)
    return L.cytotype_layers(cells, 5, grid_for(spark, sf)).select("r", "c", "cytotype", "cytotype_filled")


@query(
    ctes("cells")
    + " select cell_id, r, c, "
    + sql_r6("elev", "height")
    + """ from cells
    where 320000 + (c + 5e-1) * 10 between 320300 and 320700 and 45e5 - (r + 5e-1) * 10 between 4499600 and 4500000"""
)
def bbox_crop(spark, sf):
    cropped = grid_for(spark, sf).crop(view(spark, sf, "cells"), 320300, 320700, 4499600, 4500000)
    return rounded(cropped.select("cell_id", "r", "c", "elev", "height"), "elev", "height")


@query(
    ctes("attrs")
    + """
    select cell_id, case when cyto_raw > 5e-1 then 'diploid' when cyto_raw >= 0 then 'triploid' end as cytotype from attrs"""
)
def recode_classes(spark, sf):
    raw = A.clamp_below(F.col("cyto_raw"), 0.0)
    return view(spark, sf, "attrs").select("cell_id", A.recode_threshold(raw, 0.5, "diploid", "triploid").alias("cytotype"))


TRIM = FO.TRIM
#: What a row of the training frame must have besides.
COMPLETE_SQL = " and ".join(f"{c} is not null" for c in ["diploid_fraction", "damage_survey", "damage_lidar", *TRIM])


def _quantile_sql(column: str, p: str, source: str) -> str:
    """Interpolated quantile by explicit order statistics."""
    return f"""(select max(case when k = floor(h) then v end)
        + max(h - floor(h)) * (max(case when k = ceil(h) then v end) - max(case when k = floor(h) then v end))
      from (select {column} as v, row_number() over (order by {column}) - 1 as k, (count(*) over () - 1) * {p} as h
            from {source}) s)"""


@query(
    ctes("cells", "attrs")
    + f""", {FULL_SQL}, {TERRAIN_SQL}, {STACK_SQL}, frame as (select * from stack where {COMPLETE_SQL})
    select cell_id, {sql_r6(*TRIM)} from frame where """
    + " and ".join(
        f"{c} > {_quantile_sql(c, '1e-2', 'frame')} and {c} < {_quantile_sql(c, '99e-2', 'frame')}" for c in TRIM
    )
)
def quantile_trim(spark, sf):
    g = grid_for(spark, sf)
    cells = L.cell_table(L.layer_stack(full_cells(spark, sf), g, BLOCK, TILE), g)
    return rounded(FO.training_frame(cells).select("cell_id", *TRIM), *TRIM)


@query(
    ctes("cells")
    + """
    select cell_id, r, c, 320000 + (c + 5e-1) * 10 as x, 45e5 - (r + 5e-1) * 10 as y, cell_id as back from cells"""
)
def cell_index_xy(spark, sf):
    g = grid_for(spark, sf)
    df = view(spark, sf, "cells").select("cell_id").withColumns({"r": g.row_of(), "c": g.col_of()})
    df = g.with_xy(df)
    return df.withColumn("back", g.cell_id(g.row_at("y"), g.col_at("x")))
