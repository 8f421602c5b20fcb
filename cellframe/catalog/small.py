"""Small relational helpers."""

from pyspark.sql import functions as F

from cellframe.catalog.base import ctes, full_cells, query, r6, rounded, sql_r6, table, view
from cellframe.catalog.base import FULL_SQL
from cellframe.functions.binning import equal_breaks
from cellframe.functions.text import band_number, strip_prefix
from cellframe.operators.stack import union_all


@query(
    ctes("cells", "attrs")
    + f", {FULL_SQL} select cell_id, {sql_r6('elev', 'trait_n', 'dh')}, first_year from full_cells"
    + " where elev is not null and trait_n is not null and dh is not null and first_year is not null"
)
def complete_cases(spark, sf):
    df = full_cells(spark, sf).select("cell_id", "elev", "trait_n", "dh", "first_year").dropna()
    return rounded(df, "elev", "trait_n", "dh")


@query(
    ctes("sites")
    + " select site_code, ploidy from sites where ploidy not in ('nan', '') and dead in (1, 3, 5, 7, 9, 11)"
)
def set_filter(spark, sf):
    return (
        view(spark, sf, "sites")
        .filter(~F.col("ploidy").isin("nan", "") & F.col("dead").isin(1, 3, 5, 7, 9, 11))
        .select("site_code", "ploidy")
    )


@query(
    """select 'returned' as source, cast(l_returnflag as varchar) as label, count(*) as n from lineitem group by 2
    union all select 'status', o_orderstatus, count(*) from orders group by 2
    union all select 'segment', c_mktsegment, count(*) from customer group by 2"""
)
def union_results(spark, sf):
    parts = [
        ("returned", "lineitem", "l_returnflag"),
        ("status", "orders", "o_orderstatus"),
        ("segment", "customer", "c_mktsegment"),
    ]
    return union_all(
        [
            table(spark, sf, t)
            .groupBy(F.col(col).alias("label"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(name).alias("source"), "label", "n")
            for name, t, col in parts
        ]
    )


@query(
    ctes("cells")
    + """, s as (select min(elev) as lo, max(elev) as hi from cells)
    select cast(i as int) as i, round(case when i = 9 then hi else lo + i * ((hi - lo) / 9e0) end, 6) + 0e0 as edge
    from s cross join (select unnest(range(0, 10)) as i) n"""
)
def global_breaks(spark, sf):
    span = view(spark, sf, "cells").agg(F.min("elev").alias("lo"), F.max("elev").alias("hi"))
    edges = F.array(*equal_breaks(F.col("lo"), F.col("hi"), 10))
    return rounded(span.select(F.posexplode(edges).alias("i", "edge")), "edge")


@query(
    """select c_custkey, lower(c_mktsegment) as segment, replace(c_name, 'Customer#', 'W') as band_name,
      cast(replace(c_name, 'Customer#', '') as double) as number, length(c_name) as name_length,
      c_mktsegment || '+' || cast(c_nationkey as varchar) as pasted,
      regexp_matches(c_mktsegment, 'BUILD|HOUSE') as matched, printf('seg_%s_%03d', c_mktsegment, c_nationkey) as shown from customer"""
)
def string_cleanup(spark, sf):
    c = table(spark, sf, "customer")
    band = F.regexp_replace("c_name", "Customer#", "W")
    return c.select(
        "c_custkey",
        F.lower("c_mktsegment").alias("segment"),
        band.alias("band_name"),
        band_number(band, "W").alias("number"),
        F.length("c_name").cast("bigint").alias("name_length"),
        F.concat_ws("+", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("pasted"),
        F.col("c_mktsegment").rlike("BUILD|HOUSE").alias("matched"),
        F.format_string("seg_%s_%03d", "c_mktsegment", "c_nationkey").alias("shown"),
    )


@query(
    """select event_id, round(cos(value), 6) + 0e0 as cosine, round(sqrt(value), 6) + 0e0 as root,
      round(abs(value - 50), 6) + 0e0 as distance, cast(floor(value) as bigint) as whole, round(value / 1e4, 9) + 0e0 as scaled,
      round(value / 11, 6) + 0e0 as fraction, value > 50 as high, try_cast(event_type as double) as not_a_number from events"""
)
def math_rescale(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id",
        r6(F.cos(v)).alias("cosine"),
        r6(F.sqrt(v)).alias("root"),
        r6(F.abs(v - 50)).alias("distance"),
        F.floor(v).alias("whole"),
        r6(v / 10000.0, 9).alias("scaled"),
        r6(v / 11).alias("fraction"),
        (v > 50).alias("high"),
        F.col("event_type").try_cast("double").alias("not_a_number"),
    )


@query(
    """select l_returnflag as label, l_linestatus as part, round(avg(l_quantity), 6) + 0e0 as m,
      round(stddev_samp(l_quantity), 6) + 0e0 as s from lineitem group by 1, 2 order by 1, 2"""
)
def sorted_summary(spark, sf):
    return rounded(
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("part"))
        .agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s")),
        "m",
        "s",
    ).orderBy("label", "part")


@query(
    """select p_partkey, regexp_replace(p_name, '^(red|blue)[ .]', '') as name, lower(p_type) as type from part"""
)
def label_prefix(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        strip_prefix(F.col("p_name"), "(red|blue)").alias("name"),
        F.lower("p_type").alias("type"),
    )


@query(
    ctes("cells")
    + " select cell_id, r as row_no, c as col_no, "
    + sql_r6("elev as elevation", "height as height_canopy")
    + " from cells"
)
def select_rename(spark, sf):
    cells = view(spark, sf, "cells")
    picked = cells.select("cell_id", *[n for n in cells.columns if n in ("r", "c") or n.startswith(("elev", "heig"))])
    named = picked.withColumnsRenamed(
        {"r": "row_no", "c": "col_no", "elev": "elevation", "height": "height_canopy", "absent": "ignored"}
    )
    return rounded(named.drop("shade"), "elevation", "height_canopy")
