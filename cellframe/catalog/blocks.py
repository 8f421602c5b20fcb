"""Block aggregation, the modelling table and neighbourhood operators."""

from pyspark.sql import functions as F

from cellframe.catalog.base import (
    BLOCK,
    CYTOTYPE_SQL,
    FULL_SQL,
    MODEL_COLUMNS,
    NCOL,
    TERRAIN_SQL,
    TILE,
    ctes,
    full_cells,
    grid_for,
    model_ctes,
    modelling,
    query,
    r6,
    rounded,
    sql_r6,
    view,
)
from cellframe.grid import Grid
from cellframe.operators import blocks as B
from cellframe.operators import focal
from cellframe.plans import layers as L


@query(
    ctes("cells")
    + " select cast((r - r % 5) / 5 as bigint) as br, cast((c - c % 5) / 5 as bigint) as bc, "
    + sql_r6("avg(elev) as elev", "avg(height) as height", "avg(cast(cover as double)) as cover")
    + " from cells group by 1, 2"
)
def block_mean(spark, sf):
    return rounded(B.block_mean(view(spark, sf, "cells"), BLOCK, ["elev", "height", "cover"]), "elev", "height", "cover")


@query(
    ctes("cells", "attrs")
    + f""", {FULL_SQL}
    select cast((r - r % 5) / 5 as bigint) as br, cast((c - c % 5) / 5 as bigint) as bc,
      {sql_r6("median(height) as height", "median(cytotype) as cytotype")}
    from (select r, c, height, {CYTOTYPE_SQL} as cytotype from full_cells) t group by 1, 2"""
)
def block_median(spark, sf):
    cyto = L.cytotype(F.col("cyto_raw"), F.col("cover"), F.col("shade"))
    df = full_cells(spark, sf).withColumn("cytotype", cyto)
    out = B.block_aggregate(
        df, BLOCK, {"height": F.median("height"), "cytotype": B.binary_median(F.col("cytotype"))}
    )
    return rounded(out, "height", "cytotype")


@query(
    ctes("cells")
    + """, b as (select (r - r % 20) / 20 as br, (c - c % 20) / 20 as bc, avg(elev) as m from cells group by 1, 2)
    select c.r, c.c, round(b.m, 6) + 0e0 as elev_block from cells c join b
    on b.br = (c.r - c.r % 20) / 20 and b.bc = (c.c - c.c % 20) / 20"""
)
def block_disaggregate(spark, sf):
    cells = view(spark, sf, "cells")
    means = B.block_mean(cells, 20, ["elev"]).withColumnRenamed("elev", "elev_block")
    return rounded(B.disaggregate(means, cells.select("r", "c"), 20), "elev_block")


@query(
    ctes("cells") + f", {TERRAIN_SQL} select r, c, {sql_r6('slope', 'aspect', 'cos_aspect')} from terrain"
)
def slope_aspect(spark, sf):
    out = focal.slope_aspect(view(spark, sf, "cells"), grid_for(spark, sf), "elev", TILE).filter("slope IS NOT NULL")
    return rounded(out, "slope", "aspect", "cos_aspect")


@query(
    model_ctes()
    + " select 1 + r * 20 + c as cell_id, r, c, 320000 + (c + 5e-1) * 50 as x, 45e5 - (r + 5e-1) * 50 as y, "
    + sql_r6(*MODEL_COLUMNS)
    + " from model"
)
def modelling_table(spark, sf):
    return rounded(modelling(spark, sf), *MODEL_COLUMNS)


RESAMPLED = ", ".join(
    [
        "t as (select r, c, 320003 + (c + 5e-1) * 125e-1 as x, 4499996 - (r + 5e-1) * 125e-1 as y from "
        "(select unnest(range(0, (select cast(ceil(count(*) / 1e2 * 8e-1) as bigint) from cells))) as r) a, "
        "(select unnest(range(0, 80)) as c) b)",
        "u as (select r, c, (x - 320000) / 10 - 5e-1 as fc, (45e5 - y) / 10 - 5e-1 as fr from t)",
        "w as (select r, c, cast(floor(fr) as bigint) as r0, cast(floor(fc) as bigint) as c0, fr - floor(fr) as wr, "
        "fc - floor(fc) as wc from u)",
    ]
)


@query(
    ctes("cells")
    + f""", {RESAMPLED},
    n as (select w.r, w.c, r0 + dr as nr, c0 + dc as nc, case when dr = 1 then wr else 1 - wr end * case when dc = 1 then wc else 1 - wc end as k
      from (select w.*, t.x, t.y from w join t on t.r = w.r and t.c = w.c) w cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc)
      where x between 320000 and 321000 and y between 45e5 - 10 * (select ceil(count(*) / 1e2) from cells) and 45e5)
    select n.r, n.c, round(sum(k * elev) / sum(k), 5) + 0e0 as elev from n join cells m on m.r = nr and m.c = nc
    where elev is not null and k > 0 group by 1, 2"""
)
def resample_bilinear(spark, sf):
    src = grid_for(spark, sf)
    target = Grid(320003.0, 4499996.0, 12.5, 12.5, -(-src.nrow * 8 // 10), NCOL * 8 // 10)
    return focal.resample_bilinear(view(spark, sf, "cells"), src, target, "elev").withColumn("elev", r6("elev", 5))


@query(
    ctes("cells")
    + """, t as (select r, c, 320003 + (c + 5e-1) * 125e-1 as x, 4499996 - (r + 5e-1) * 125e-1 as y from
      (select unnest(range(0, (select cast(ceil(count(*) / 1e2 * 8e-1) as bigint) from cells))) as r) a,
      (select unnest(range(0, 80)) as c) b)
    select t.r, t.c, k.cover from t join cells k
    on k.c = cast(floor((t.x - 320000) / 10) as bigint) and k.r = cast(floor((45e5 - t.y) / 10) as bigint)"""
)
def resample_near(spark, sf):
    src = grid_for(spark, sf)
    target = Grid(320003.0, 4499996.0, 12.5, 12.5, -(-src.nrow * 8 // 10), NCOL * 8 // 10)
    return focal.resample_near(view(spark, sf, "cells"), src, target, "cover")
