"""Polygons, outlines and coordinates."""

from pyspark.sql import functions as F

from cellframe.catalog.base import ctes, grid_for, polygons, query, r6, rounded, sql_r6, view
from cellframe.functions import geodesy as GEO
from cellframe.operators import footprint as FP
from cellframe.operators import polygons as P

_INSIDE = """abs(320000 + (c.c + 5e-1) * 10 - d.cx) + abs(45e5 - (c.r + 5e-1) * 10 - d.cy) < d.hw
      and not abs(320000 + (c.c + 5e-1) * 10 - d.cx) + abs(45e5 - (c.r + 5e-1) * 10 - d.cy) < d.hole_hw"""


@query(
    ctes("cells", "diamonds")
    + f" select distinct d.year, c.r, c.c, 1e0 as value from diamonds d join cells c on {_INSIDE} where d.host_code = 746"
)
def rasterize_by_year(spark, sf):
    return P.rasterize(P.select_host(polygons(spark, sf), 746), grid_for(spark, sf))


@query(
    ctes("cells", "diamonds")
    + f""" select d.poly_id, count(*) as n_cells, {sql_r6('avg(c.height) as mean_height', 'avg(c.elev) as mean_elev')}
    from diamonds d join cells c on {_INSIDE} group by d.poly_id"""
)
def polygon_cell_join(spark, sf):
    inside = P.polygon_cells(polygons(spark, sf), grid_for(spark, sf))
    joined = inside.join(view(spark, sf, "cells"), ["r", "c"])
    out = joined.groupBy("poly_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("height").alias("mean_height"), F.avg("elev").alias("mean_elev")
    )
    return rounded(out, "mean_height", "mean_elev")


@query(
    ctes("cells", "diamonds")
    + f""", presence as (
      select distinct d.year, c.r, c.c from diamonds d join cells c on {_INSIDE} where d.host_code = 746)
    select r, c, cast(count(*) as double) as n_years, min(year) as first_year from presence group by r, c"""
)
def polygon_damage_composite(spark, sf):
    from cellframe.operators.stack import composite

    return composite(P.rasterize(P.select_host(polygons(spark, sf), 746), grid_for(spark, sf)))


_RINGS_SQL = """
    , rings as (
      select poly_id, year, cast(1 as int) as ring_no, false as hole, cx, cy, hw as h from diamonds
      union all select poly_id, year, 2, true, cx, cy, hole_hw from diamonds where hole_hw > 0),
    pts as (
      select poly_id, year, ring_no, hole, cast(v as int) as vertex_no,
        case v when 1 then cx - h when 3 then cx + h else cx end as x,
        case v when 2 then cy + h when 4 then cy - h else cy end as y
      from rings cross join (select unnest(range(1, 5)) as v) n)"""


@query(ctes("diamonds") + _RINGS_SQL + f" select poly_id, year, ring_no, hole, vertex_no, {sql_r6('x', 'y')} from pts")
def polygon_vertices(spark, sf):
    v = P.vertices(polygons(spark, sf))
    return rounded(v.select("poly_id", "year", "ring_no", "hole", "vertex_no", "x", "y"), "x", "y")


@query(
    ctes("diamonds")
    + _RINGS_SQL
    + f" select poly_id, ring_no, vertex_no, {sql_r6('x', 'y')} from pts where hole"
)
def polygon_holes(spark, sf):
    v = P.hole_vertices(polygons(spark, sf))
    return rounded(v.select("poly_id", "ring_no", "vertex_no", "x", "y"), "x", "y")


_EDGES_SQL = """
    , b as (select distinct cast((r - r % 10) / 10 as bigint) as br, cast((c - c % 10) / 10 as bigint) as bc
            from cells where elev is not null),
    u as (select axis, line, pos from (
        select 'h' as axis, br as line, bc as pos from b union all select 'h', br + 1, bc from b
        union all select 'v', bc, br from b union all select 'v', bc + 1, br from b) t
      group by 1, 2, 3 having count(*) = 1),
    seg as (select axis, line, min(pos) as p0, max(pos) + 1 as p1
      from (select axis, line, pos, pos - row_number() over (partition by axis, line order by pos) as g from u) t
      group by axis, line, g)"""


@query(
    ctes("cells")
    + _EDGES_SQL
    + """ select axis,
      case when axis = 'h' then 320000e0 + p0 * 1e2 else 320000e0 + line * 1e2 end as x1,
      case when axis = 'h' then 45e5 - line * 1e2 else 45e5 - p0 * 1e2 end as y1,
      case when axis = 'h' then 320000e0 + p1 * 1e2 else 320000e0 + line * 1e2 end as x2,
      case when axis = 'h' then 45e5 - line * 1e2 else 45e5 - p1 * 1e2 end as y2 from seg"""
)
def footprint_segments(spark, sf):
    return FP.footprint_segments(view(spark, sf, "cells"), grid_for(spark, sf), 10, "elev")


@query(
    ctes("cells")
    + _EDGES_SQL
    + """ select count(*) as n_blocks, count(*) * 1e4 as area, 320000e0 + min(bc) * 1e2 as xmin,
      320000e0 + (max(bc) + 1) * 1e2 as xmax, 45e5 - (max(br) + 1) * 1e2 as ymin, 45e5 - min(br) * 1e2 as ymax from b"""
)
def footprint_summary(spark, sf):
    return FP.footprint_summary(view(spark, sf, "cells"), grid_for(spark, sf), 10, "elev")


def _lonlat_sql() -> str:
    """Inverse series with the constants worked out, applied to the sites."""
    size = GEO.SCALE * GEO._radius
    xi = "y / {s!r}::double".format(s=size)
    eta = "(x - 5e5) / {s!r}::double".format(s=size)
    sx = " ".join(f"- {b!r}::double * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(GEO._beta, 1))
    se = " ".join(f"- {b!r}::double * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(GEO._beta, 1))
    ph = " ".join(f"+ {d!r}::double * sin({2 * j} * chi)" for j, d in enumerate(GEO._delta, 1))
    return f"""
    , a as (select site_code, x, y, {xi} as xi, {eta} as eta from sites),
    b as (select site_code, xi {sx} as xp, eta {se} as ep from a),
    g as (select site_code, xp, ep, asin(sin(xp) / cosh(ep)) as chi from b)
    select site_code, round(-105 + degrees(atan2(sinh(ep), cos(xp))), 6) + 0e0 as lon,
      round(degrees(chi {ph}), 6) + 0e0 as lat, true as returns from g"""


@query(ctes("sites") + _lonlat_sql())
def utm_roundtrip(spark, sf):
    sites = view(spark, sf, "sites")
    lon, lat = GEO.to_lonlat(F.col("x"), F.col("y"), 13)
    df = sites.select("site_code", "x", "y", lon.alias("lon"), lat.alias("lat"))
    east, north = GEO.to_utm(F.col("lon"), F.col("lat"), 13)
    gap = F.greatest(F.abs(east - F.col("x")), F.abs(north - F.col("y")))
    return df.select("site_code", r6("lon").alias("lon"), r6("lat").alias("lat"), (gap < 1e-3).alias("returns"))
