import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellframe import Grid
from cellframe.spark import explode_range

G = Grid(1000.0, 9000.0, 10.0, 20.0, 40, 25)


def test_index_round_trip(spark):
    d = G.with_xy(G.domain(spark)).withColumns({"r2": G.row_at("y"), "c2": G.col_at("x")})
    d = d.withColumn("back", G.cell_id("r2", "c2"))
    assert d.count() == 1000
    assert d.filter("back <> cell_id OR r2 <> r OR c2 <> c").count() == 0
    assert d.agg(F.min("cell_id"), F.max("cell_id")).first() == (1, 1000)


def test_points_on_and_outside_the_edge(spark):
    pts = spark.createDataFrame(
        [(1000.0, 9000.0), (1250.0, 8200.0), (1010.0, 8980.0), (999.9, 8500.0), (1100.0, 9000.1)], "x double, y double"
    )
    got = pts.select(G.row_at("y"), G.col_at("x")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (39, 24), (1, 1), (25, None), (None, 10)]


def test_crop_is_a_plain_range(spark):
    df = G.domain(spark)
    inside = G.crop(df, 1020, 1050, 8800, 8900).agg(F.min("r"), F.max("r"), F.min("c"), F.max("c"), F.count("*")).first()
    assert tuple(inside) == (5, 9, 2, 4, 15)
    assert G.crop(df, 0, 10_000, 0, 10_000).count() == G.ncell


@pytest.mark.parametrize("max_cells,stride", [(1000, 1), (999, 2), (250, 2), (100, 4), (1, 32)])
def test_stride(max_cells, stride):
    assert G.stride_for(max_cells) == stride


def test_coarsen_keeps_partial_blocks():
    g = G.coarsen(7)
    assert (g.nrow, g.ncol, g.xres, g.yres) == (6, 4, 70.0, 140.0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-30, 30), st.integers(-5, 40)), min_size=1, max_size=5), st.integers(1, 9))
def test_explode_range(spark, pairs, chunk):
    df = spark.createDataFrame([(i, a, a + n) for i, (a, n) in enumerate(pairs)], "i int, a int, b int")
    got = sorted((r.i, r.k) for r in explode_range(df, F.col("a"), F.col("b"), "k", chunk).collect())
    assert got == [(i, v) for i, (a, n) in enumerate(pairs) for v in range(a, a + n + 1)]


def test_cropped_grid_numbers_its_own_cells(spark):
    g = Grid(100.0, 200.0, 10.0, 10.0, 8, 6)
    cells, inner = g.cropped(g.domain(spark), 120.0, 150.0, 150.0, 180.0)
    assert (inner.xmin, inner.ymax, inner.nrow, inner.ncol) == (120.0, 180.0, 3, 3)
    whole = {r.cell_id: (r.x, r.y) for r in g.with_xy(g.domain(spark)).collect()}
    rows = inner.with_xy(cells).collect()
    assert len(rows) == 9 and all(whole[r.cell_id] == (r.x, r.y) for r in rows)
    assert inner.stride_for(4) == 2 and g.stride_for(4) == 4
