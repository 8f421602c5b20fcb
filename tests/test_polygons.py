import random

import pytest
from pyspark.sql import functions as F

from cellframe import Grid
from cellframe.operators import polygons as P
from cellframe.sources.readers import normalize_polygons

DDL = f"poly_id bigint, year int, host_code int, area double, rings {P.RINGS_DDL}"
G = Grid(0.0, 100.0, 1.0, 2.0, 50, 80)


def ring(pts, hole=False):
    return (hole, [(float(x), float(y)) for x, y in pts])


def polys(spark, *shapes):
    rows = [(i, 2000 + i % 2, 746, 1.0, list(s)) for i, s in enumerate(shapes)]
    return spark.createDataFrame(rows, DDL)


def inside(x, y, rings):
    """Even-odd rule, one point at a time."""
    odd = False
    for _, pts in rings:
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def brute(rings, g=G):
    return {
        (r, c)
        for r in range(g.nrow)
        for c in range(g.ncol)
        if inside(g.xmin + (c + 0.5) * g.xres, g.ymax - (r + 0.5) * g.yres, rings)
    }


def test_rectangle_area(spark):
    box = [ring([(10, 20), (40, 20), (40, 60), (10, 60)])]
    got = P.polygon_cells(polys(spark, box), G)
    assert got.count() == 30 * 20
    lim = got.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    assert tuple(lim) == (20, 39, 10, 39)


@pytest.mark.parametrize("seed", range(4))
def test_random_shapes_with_holes_match_point_tests(spark, seed):
    rng = random.Random(seed)
    shapes = []
    for _ in range(6):
        outer = ring([(rng.uniform(-20, 100), rng.uniform(-20, 120)) for _ in range(rng.randint(3, 9))])
        hole = ring([(rng.uniform(0, 80), rng.uniform(0, 100)) for _ in range(3)], True)
        shapes.append([outer, hole] if rng.random() < 0.5 else [outer])
    got = {}
    for x in P.polygon_cells(polys(spark, *shapes), G).collect():
        got.setdefault(x.poly_id, set()).add((x.r, x.c))
    for i, s in enumerate(shapes):
        assert got.get(i, set()) == brute(s)


def test_neighbours_share_an_edge_without_gap_or_overlap(spark):
    left = [ring([(0, 0), (33.3, 0), (21.7, 100), (0, 100)])]
    right = [ring([(33.3, 0), (80, 0), (80, 100), (21.7, 100)])]
    cells = P.polygon_cells(polys(spark, left, right), G)
    assert cells.count() == cells.select("r", "c").distinct().count() == G.ncell


def test_rasterize_merges_polygons_of_a_year(spark):
    a = [ring([(0, 0), (10, 0), (10, 20), (0, 20)])]
    b = [ring([(5, 0), (15, 0), (15, 20), (5, 20)])]
    out = P.rasterize(polys(spark, a, b, b), G)
    assert {(x.year, x["count"]) for x in out.groupBy("year").count().collect()} == {(2000, 150), (2001, 100)}


def test_vertices_parts_and_rings(spark):
    shape = [ring([(0, 0), (4, 0), (4, 4)]), ring([(1, 1), (2, 1), (2, 2)], True)]
    df = polys(spark, shape)
    assert P.parts(df).count() == 2
    v = P.vertices(df).orderBy("ring_no", "vertex_no").collect()
    assert [(x.ring_no, x.vertex_no, x.hole, x.x, x.y) for x in v][:2] == [(1, 1, False, 0.0, 0.0), (1, 2, False, 4.0, 0.0)]
    assert P.outer_vertices(df).count() == P.hole_vertices(df).count() == 3
    assert P.edges(df).count() == 6


def test_schema_drift(spark):
    r = [ring([(0, 0), (1, 0), (1, 1)])]
    old = spark.createDataFrame([(1, 746, r), (2, None, r)], f"poly_id int, HOST1 int, rings {P.RINGS_DDL}")
    new = spark.createDataFrame([(3, 746, 2.5, r), (4, 746, None, r)], f"poly_id int, HOST_CODE int, Area double, rings {P.RINGS_DDL}")
    both = normalize_polygons(old, 2016).unionByName(normalize_polygons(new, 2018))
    assert {x.poly_id for x in P.select_host(both, 746).collect()} == {1, 3, 4}
    assert {x.poly_id for x in P.select_host(both, 746, dated_area=True).collect()} == {3}
