"""Inputs of the registered queries.

The driver tables stand in for field data: one order is one cell of a 100-column grid of
10 m cells, its line items carry the per-cell attributes, suppliers are survey polygons,
customers are field sites and embeddings are spectra. Each input is defined once, as SQL
text that both engines run; the operators under test are never part of that text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.grid import Grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

NCOL, RES, XMIN, YMAX = 100, 10.0, 320000.0, 4500000.0
BLOCK = 5  # cells per block side
SPATIAL_BLOCK = 200.0  # metres
TILE = 50  # cells per tile side; a multiple of every block factor used here
YEARS = list(range(1995, 2002))
BANDS, BAND_STEP, FIRST_BAND = 64, 5.0, 380.0
BAD = [(1, 3), (30, 33), (62, 64)]

VIEWS: dict[str, str] = {
    "cells": """
        select cell_id, r, c,
               case when ((r - r % 20) / 20 + (c - c % 20) / 20) % 5 = 4 then null
                    else 2600e0 + 7e0 * (r % 150) + 5e-1 * c + p / 93e3 end as elev,
               case when k % 10 < 8 then cast(((r - r % 10) / 10 + (c - c % 20) / 20) % 3 as bigint)
                    else k % 3 end as cover,
               case when st = 'F' and k % 4 = 0 then 0 else 1 end as shade,
               p / 17e3 as height
        from (select o_orderkey + 1 as cell_id, cast((o_orderkey - o_orderkey % 100) / 100 as bigint) as r,
                     o_orderkey % 100 as c, o_custkey as k, o_orderstatus as st, o_totalprice as p
              from {orders}) b""",
    "attrs": """
        select l_orderkey + 1 as cell_id,
               case when sum(l_linenumber) % 11 = 0 then -1e0
                    when min(((l_orderkey - l_orderkey % 500) / 500 + (l_orderkey % 100 - l_orderkey % 5) / 5) % 4) = 0 then 1e0
                    when min(((l_orderkey - l_orderkey % 500) / 500 + (l_orderkey % 100 - l_orderkey % 5) / 5) % 4) = 1 then 0e0
                    else cast(sum(cast(round(l_discount * 100) as bigint)) as double) / (1e1 * count(*)) end as cyto_raw,
               cast(sum(cast(l_quantity as bigint)) as double) / (4e0 * count(*)) as trait_n,
               cast(sum(cast(round(l_tax * 100) as bigint)) as double) / (25e0 * count(*)) as trait_n_unc,
               -32e0 + cast(sum(l_partkey % 12) as double) / count(*) as trait_d13c,
               cast(sum(l_suppkey % 11) as double) / (1e1 * count(*)) as trait_d13c_unc,
               cast(sum(cast(round(l_extendedprice) as bigint)) as double) / (1e2 * count(*)) as cwc,
               cast(min(cast(round((l_discount - l_tax) * 100) as bigint)) as double) as dh,
               min(case when l_returnflag = 'R' then cast(year(l_shipdate) as int) end) as first_year
        from {lineitem} group by l_orderkey + 1""",
    "damage_year": """
        select distinct l_orderkey + 1 as cell_id, cast(year(l_shipdate) as int) as year
        from {lineitem} where l_returnflag = 'R'""",
    "diamonds": """
        select s_suppkey as poly_id, cast(1995 + s_nationkey % 7 as int) as year,
               cast(case when s_nationkey % 2 = 0 then 746 else 122 end as int) as host_code,
               case when s_suppkey % 5 <> 0 then abs(s_acctbal) end as area,
               320000e0 + (s_suppkey * 7 % 100) * 10 as cx,
               45e5 - (s_suppkey * 13 % (select cast((count(*) + 99 - (count(*) + 99) % 100) / 100 as bigint)
                                         from {orders})) * 10 as cy,
               20e0 + abs(s_acctbal) / 100 as hw,
               case when s_suppkey % 3 = 0 then (20e0 + abs(s_acctbal) / 100) / 3 else 0e0 end as hole_hw
        from {supplier}""",
    "sites": """
        select c_custkey as site_code, c_custkey % 12 as dead,
               case when c_custkey % 17 = 0 then 'nan' when c_custkey % 19 = 0 then ''
                    when c_mktsegment in ('BUILDING', 'HOUSEHOLD') then 'Diploid' else 'Triploid' end as ploidy,
               320000e0 + ((c_custkey * 37) % 100) * 10 + (c_custkey % 9) + 5e-1 as x,
               45e5 - ((c_custkey * 53) % (select cast((count(*) + 99 - (count(*) + 99) % 100) / 100 as bigint)
                                           from {orders})) * 10 - (c_custkey % 7) - 25e-2 as y
        from {customer}""",
    "spectra": """
        select vec_id, vec_id * 4 as site_code, label, embedding as refl,
               case when vec_id % 7 = 0 then 0 else 1 end as shade, vec_id % 3 as cover
        from {embeddings}""",
}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL counterpart if it has one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# Given schemas: without them every read starts with a job that opens the footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A named input as a DataFrame."""
    text = VIEWS[name]
    used = {t: table(spark, sf, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def ctes(*names: str) -> str:
    """``with`` clause that defines the named inputs for the SQL side."""
    parts = [f"{n} as ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names]
    return "with " + ",\n".join(parts)


@lru_cache
def grid_for(spark: SparkSession, sf: str) -> Grid:
    """Grid of the cells: the row count comes from the parquet footers, once per folder."""
    n = table(spark, sf, "orders").count()
    return Grid(XMIN, YMAX, RES, RES, -(-n // NCOL), NCOL, "utm13")


def full_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell with its attributes (NULL where it has none)."""
    return view(spark, sf, "cells").join(view(spark, sf, "attrs"), "cell_id", "left")


def polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Survey polygons with native rings: a diamond, every third one with a hole."""
    d = view(spark, sf, "diamonds")

    def ring(half: Column, hole: bool) -> Column:
        cx, cy = F.col("cx"), F.col("cy")
        corners = [(cx - half, cy), (cx, cy + half), (cx + half, cy), (cx, cy - half)]
        pts = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])
        return F.struct(F.lit(hole).alias("hole"), pts.alias("pts"))

    outer, inner = ring(F.col("hw"), False), ring(F.col("hole_hw"), True)
    rings = F.when(F.col("hole_hw") > 0, F.array(outer, inner)).otherwise(F.array(outer))
    return d.select("poly_id", "year", "host_code", "area", rings.alias("rings"))


def r6(col: Column | str, digits: int = 6) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def sql_r6(*exprs: str) -> str:
    """``round(e, 6) + 0e0 as name`` for ``e as name`` items (or bare names)."""
    out = []
    for e in exprs:
        expr, _, name = e.rpartition(" as ")
        out.append(f"round({expr or name}, 6) + 0e0 as {name}")
    return ", ".join(out)


# SQL building blocks shared by several counterparts -------------------------------------

FULL_SQL = "full_cells as (select * from cells left join attrs using (cell_id))"

CYTOTYPE_SQL = "case when cover = 0 and shade = 1 and cyto_raw >= -1e-4 then case when cyto_raw > 5e-1 then 1e0 else 0e0 end end"

TERRAIN_SQL = """
    horn as (
      select r, c, sum(wx * z) / 8e1 as p, sum(wy * z) / 8e1 as q
      from (select m.r + o.dr as r, m.c + o.dc as c, m.elev as z, o.wx, o.wy
            from cells m cross join (values
              (-1, -1, 1, -1), (-1, 0, 0, -2), (-1, 1, -1, -1), (0, -1, 2, 0), (0, 0, 0, 0), (0, 1, -2, 0),
              (1, -1, 1, 1), (1, 0, 0, 2), (1, 1, -1, 1)) o(dr, dc, wx, wy)) t
      group by r, c having count(z) = 9),
    terrain as (
      select r, c, degrees(atan(sqrt(p * p + q * q))) as slope,
        case when p * p + q * q > 0 then -q / sqrt(p * p + q * q) end as cos_aspect,
        case when p * p + q * q > 0 then case when atan2(-p, -q) < 0 then atan2(-p, -q) + 2 * pi()
          else atan2(-p, -q) end end as aspect
      from horn)"""

STACK_SQL = f"""
    stack as (
      select f.cell_id, f.r, f.c,
        case when {CYTOTYPE_SQL} is not null then 1e0 else 0e0 end as cover_fraction,
        {CYTOTYPE_SQL} as diploid_fraction,
        case when elev is not null and first_year is not null then 1e0 else 0e0 end as damage_survey,
        case when dh >= -1e2 then case when dh < -3 then 1e0 else 0e0 end end as damage_lidar,
        elev as elevation, t.cos_aspect, t.slope,
        case when elev is null or trait_n_unc > 15e-2 or trait_n < 0 or trait_n > 10 then null else trait_n end as trait_n,
        case when elev is null or trait_d13c_unc > 8e-1 or trait_d13c < -30 or trait_d13c > -22 then null
          else trait_d13c end as trait_d13c,
        cwc as trait_cwc, height
      from full_cells f left join terrain t on t.r = f.r and t.c = f.c)"""

MODEL_COLUMNS = [
    "cover_fraction",
    "diploid_fraction",
    "damage_survey",
    "damage_lidar",
    "elevation",
    "cos_aspect",
    "slope",
    "trait_n",
    "trait_d13c",
    "trait_cwc",
    "height",
]

MODEL_SQL = (
    "model as materialized (select * from (select cast((r - r % 5) / 5 as bigint) as r, cast((c - c % 5) / 5 as bigint) as c, "
    + ", ".join(f"avg({n}) as {n}" for n in MODEL_COLUMNS)
    + " from stack group by 1, 2) g where cover_fraction > 0)"
)


def model_ctes(*more: str) -> str:
    """Definitions up to the modelling table, for the SQL side."""
    return ",\n".join([ctes("cells", "attrs"), FULL_SQL, TERRAIN_SQL, STACK_SQL, MODEL_SQL, *more])


def modelling(spark: SparkSession, sf: str) -> DataFrame:
    """The modelling table of the catalog (block factor 5)."""
    from cellframe.plans.layers import layer_stack, modelling_table

    g = grid_for(spark, sf)
    return modelling_table(layer_stack(full_cells(spark, sf), g, BLOCK, TILE), g, BLOCK)
