"""Sources and sinks: tables written to the shared folder and read back."""

import uuid

from pyspark.sql import functions as F

from cellframe.catalog.base import ctes, polygons, query, rounded, sql_r6, table, view
from cellframe.sources import readers, writers
from cellframe.spark import checkpoint_dir

STORE_TILE = 20


def _place(spark):
    return f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"


def _store(spark, sf):
    path = _place(spark)
    writers.write_tiled(view(spark, sf, "cells").select("r", "c", F.col("elev").alias("value")), path, STORE_TILE)
    return path


@query(ctes("cells") + " select r, c, elev as value from cells")
def tiled_store(spark, sf):
    """A layer of all cells through the tiled store."""
    return readers.read_window(spark, _store(spark, sf), STORE_TILE)


@query(ctes("cells") + " select r, c, elev as value from cells where r between 3 and 11 and c between 25 and 61")
def tiled_window(spark, sf):
    """A window of the tiled store: only its tiles' files are opened."""
    return readers.read_window(spark, _store(spark, sf), STORE_TILE, (3, 11), (25, 61))


@query(
    ctes("cells", "damage_year")
    + " select d.year, c.r, c.c, 1e0 as value from cells c join damage_year d on d.cell_id = c.cell_id where d.year <> 1998"
)
def yearly_files(spark, sf):
    """Yearly layers as files whose names carry the year, read in one scan; a file without a year is left out."""
    path = _place(spark)
    cells = view(spark, sf, "cells").join(view(spark, sf, "damage_year"), "cell_id").select("year", "r", "c", F.lit(1).alias("value"))
    writers.write_yearly_layers(cells.filter("year <> 1998"), f"{path}/yearly")
    writers.write_layer(cells.filter("year = 1998").select("r", "c", "value"), f"{path}/yearly/summed")
    return readers.read_yearly_stack(spark, f"{path}/yearly")


@query(ctes("sites") + " select site_code, dead, ploidy, x, y from sites where ploidy <> ''")
def csv_header(spark, sf):
    """A table through CSV with a header line."""
    path = _place(spark)
    writers.write_csv(view(spark, sf, "sites").filter("ploidy <> ''").select("site_code", "dead", "ploidy", "x", "y"), path)
    return readers.read_csv(spark, path, "site_code bigint, dead bigint, ploidy string, x double, y double")


@query(ctes("sites") + " select cast(site_code as double) as site, x, y from sites")
def csv_plain(spark, sf):
    """Numbers through CSV without a header line."""
    path = _place(spark)
    view(spark, sf, "sites").select(F.col("site_code").cast("double"), "x", "y").write.csv(path)
    return readers.read_csv_plain(spark, path, ["site", "x", "y"])


@query(
    """select l_returnflag as label, count(*) filter (where l_linestatus = 'O') as "O", count(*) filter (where l_linestatus = 'F') as "F"
    from lineitem group by 1"""
)
def csv_crosstab(spark, sf):
    """A cross table through CSV whose first heading is blank."""
    path = _place(spark)
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias(" ")).pivot("l_linestatus", ["O", "F"]).count().fillna(0)
    writers.write_csv(counts.coalesce(1), path)  # a cross table of a few labels
    return readers.read_crosstab(spark, path)


@query(
    ctes("diamonds")
    + """, v as (select poly_id, year, unnest([[cx - hw, cy], [cx, cy + hw], [cx + hw, cy], [cx, cy - hw]]) as p from diamonds)
    select poly_id, year, """
    + sql_r6("p[1] as x", "p[2] as y")
    + " from v"
)
def saved_outlines(spark, sf):
    """Outer corners of all polygons, saved as a result table and loaded again."""
    path = _place(spark)
    corners = polygons(spark, sf).select("poly_id", "year", F.explode("rings").alias("ring")).filter("not ring.hole")
    writers.write_table(corners.select("poly_id", "year", F.explode("ring.pts").alias("p")).select("poly_id", "year", "p.x", "p.y"), path)
    return rounded(readers.read_table(spark, path), "x", "y")
