"""Stacks, blocks, neighbourhoods and footprints against closed forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe import Grid
from cellframe.operators import blocks as B
from cellframe.operators import focal, footprint, stack


def plane(nrow, ncol, a, b, res=10.0):
    return {(r, c): 100 + a * (c + 0.5) * res - b * (r + 0.5) * res for r in range(nrow) for c in range(ncol)}


@pytest.mark.parametrize("a,b", [(0.3, 0.0), (0.0, 0.4), (-0.2, 0.5), (0.1, -0.7)])
@pytest.mark.parametrize("tile", [4, 250])
def test_plane_has_constant_slope_and_aspect(spark, cells, a, b, tile):
    g = Grid(0.0, 0.0, 10.0, 10.0, 9, 11)
    out = focal.slope_aspect(cells(plane(9, 11, a, b), "elev"), g, "elev", tile).filter("slope IS NOT NULL").collect()
    assert len(out) == 7 * 9
    size = math.hypot(a, b)
    for r in out:
        assert abs(r.slope - math.degrees(math.atan(size))) < 1e-9
        assert abs(r.cos_aspect - (-b / size)) < 1e-9
        assert abs(math.cos(r.aspect) - r.cos_aspect) < 1e-9
        assert abs(math.sin(r.aspect) - (-a / size)) < 1e-9


def test_flat_cells_have_no_aspect_and_gaps_spread(spark, cells):
    values = {(r, c): 5.0 for r in range(7) for c in range(7)}
    values[(1, 1)] = None
    del values[(5, 5)]
    g = Grid(0.0, 0.0, 1.0, 1.0, 7, 7)
    rows = {(x.r, x.c): x for x in focal.slope_aspect(cells(values, "elev"), g, "elev", 3).collect()}
    assert len(rows) == 48
    assert rows[(3, 3)].slope == 0 and rows[(3, 3)].aspect is None and rows[(3, 3)].cos_aspect is None
    for key in [(1, 1), (2, 2), (1, 2), (4, 4), (0, 3), (6, 2)]:
        assert rows[key].slope is None


def test_terrain_matches_numpy(spark, cells):
    rng = np.random.default_rng(5)
    z = rng.uniform(0, 50, (23, 17))
    g = Grid(0.0, 0.0, 10.0, 20.0, 23, 17)
    got = focal.slope_aspect(cells(dict(np.ndenumerate(z)), "elev"), g, "elev", 6).filter("slope IS NOT NULL")
    for row in got.collect():
        w = z[row.r - 1 : row.r + 2, row.c - 1 : row.c + 2]
        p = ((w[:, 2] - w[:, 0]) * [1, 2, 1]).sum() / 80
        q = ((w[0] - w[2]) * [1, 2, 1]).sum() / 160
        assert abs(row.slope - math.degrees(math.atan(math.hypot(p, q)))) < 1e-9
    assert got.count() == 21 * 15


@pytest.mark.parametrize("res", [(4.0, 4.0), (25.0, 30.0), (10.0, 10.0)])
def test_bilinear_reproduces_a_plane(spark, cells, res):
    src = Grid(0.0, 200.0, 10.0, 10.0, 20, 15)
    f = lambda x, y: 3 + 0.7 * x - 0.4 * y
    values = {(r, c): f((c + 0.5) * 10, 200 - (r + 0.5) * 10) for r in range(20) for c in range(15)}
    dst = Grid(2.0, 190.0, *res, int(180 // res[1]), int(140 // res[0]))
    out = {(x.r, x.c): x.value for x in focal.resample_bilinear(cells(values), src, dst).collect()}
    at = {(r, c): (2 + (c + 0.5) * res[0], 190 - (r + 0.5) * res[1]) for r in range(dst.nrow) for c in range(dst.ncol)}
    assert out.keys() == {k for k, (x, y) in at.items() if 0 <= x <= 150 and 0 <= y <= 200}
    for k, v in out.items():
        x, y = at[k]
        if 5 <= x <= 145 and 5 <= y <= 195:
            assert abs(v - f(x, y)) < 1e-9
        else:  # the half cell at the border takes its nearest cells
            assert abs(v - f(min(max(x, 5), 145), min(max(y, 5), 195))) < 1e-9


def test_bilinear_beside_a_gap_takes_the_weights_present(spark, cells):
    g = Grid(0.0, 50.0, 10.0, 10.0, 5, 5)
    values = {(r, c): float(r * 10 + c) for r in range(5) for c in range(5) if (r, c) != (2, 2)} | {(2, 2): None}
    out = {(x.r, x.c): x.value for x in focal.resample_bilinear(cells(values), g, Grid(0.0, 50.0, 5.0, 5.0, 10, 10)).collect()}
    assert len(out) == 100
    for (r, c), v in out.items():
        fr, fc = min(max((r + 0.5) / 2 - 0.5, 0), 4), min(max((c + 0.5) / 2 - 0.5, 0), 4)
        near = [(i, j, (1 - abs(fr - i)) * (1 - abs(fc - j))) for i in range(5) for j in range(5) if abs(fr - i) < 1 and abs(fc - j) < 1]
        near = [(values[i, j], w) for i, j, w in near if values.get((i, j)) is not None]
        assert v == pytest.approx(sum(x * w for x, w in near) / sum(w for _, w in near))


def test_bilinear_on_the_same_grid_is_the_identity(spark, cells):
    g = Grid(0.0, 50.0, 10.0, 10.0, 5, 6)
    values = {(r, c): float(r * 10 + c) for r in range(5) for c in range(6) if (r, c) != (2, 2)}
    out = {(x.r, x.c): x.value for x in focal.resample_bilinear(cells(values), g, g).collect()}
    assert out == values


def test_block_mean_median_and_spread(spark, cells):
    rng = random.Random(3)
    values = {(r, c): (None if rng.random() < 0.2 else float(rng.random() < 0.4)) for r in range(13) for c in range(11)}
    df = cells(values)
    want = {}
    for (r, c), v in values.items():
        want.setdefault((r // 5, c // 5), []).append(v)
    kept = {k: [v for v in vs if v is not None] for k, vs in want.items()}
    mean = {(x.br, x.bc): x.value for x in B.block_mean(df, 5, ["value"]).collect()}
    assert mean.keys() == want.keys()
    for k, vs in kept.items():
        assert abs(mean[k] - sum(vs) / len(vs)) < 1e-12
    fast = {(x.br, x.bc): x.value for x in B.block_median(df, 5, "value", binary=True).collect()}
    slow = {(x.br, x.bc): x.value for x in B.block_median(df, 5, "value").collect()}
    assert fast == slow == {k: float(np.median(vs)) for k, vs in kept.items()}
    filled = B.fill_from_block(df, 5, "value", "filled").collect()
    assert len(filled) == len(values)
    for x in filled:
        assert x.filled == (x.value if x.value is not None else fast[(x.r // 5, x.c // 5)])


def test_block_without_values_stays_null(spark, cells):
    out = B.block_mean(cells({(0, 0): None, (0, 1): None, (0, 5): 2.0}), 5, ["value"]).collect()
    assert {(x.bc, x.value) for x in out} == {(0, None), (1, 2.0)}
    med = B.block_median(cells({(0, 0): None, (0, 5): 1.0}), 5, "value", binary=True).collect()
    assert {(x.bc, x.value) for x in med} == {(0, None), (1, 1.0)}


def test_disaggregate(spark, cells):
    g = Grid(0.0, 0.0, 1.0, 1.0, 6, 6)
    blocks = spark.createDataFrame([(0, 0, 1.5), (1, 1, 2.5)], "br bigint, bc bigint, m double")
    out = B.disaggregate(blocks, g.domain(spark).select("r", "c"), 3).collect()
    assert len(out) == 36
    assert all(x.m == {(0, 0): 1.5, (1, 1): 2.5}.get((x.r // 3, x.c // 3)) for x in out)


def test_stack_and_composites(spark, cells):
    a, b = cells({(0, 0): 1, (0, 1): 2}), cells({(0, 1): 5, (3, 3): 6})
    long = stack.name_layers({"a": a, "b": b})
    wide = {(x.r, x.c): (x.a, x.b) for x in stack.stack_layers(long, ["a", "b"]).collect()}
    assert wide == {(0, 0): (1.0, None), (0, 1): (2.0, 5.0), (3, 3): (None, 6.0)}
    years = stack.parse_year(stack.name_layers({"d_Year.2003": a, "d_Year.2001": b, "other": a}))
    got = {(x.r, x.c): (x.n_years, x.first_year) for x in stack.composite(years).collect()}
    assert got == {(0, 0): (1.0, 2003), (0, 1): (7.0, 2001), (3, 3): (6.0, 2001)}


def test_footprint_of_a_ring_of_blocks(spark, cells):
    g = Grid(0.0, 30.0, 1.0, 1.0, 30, 30)
    # 3 x 3 blocks of 10 cells with the middle one empty: 4 outer and 4 inner segments
    values = {(r * 10 + 4, c * 10 + 7): 1 for r in range(3) for c in range(3) if (r, c) != (1, 1)}
    seg = footprint.footprint_segments(cells(values), g, 10, "value").collect()
    assert len(seg) == 8
    length = sum(abs(s.x2 - s.x1) + abs(s.y2 - s.y1) for s in seg)
    assert length == 4 * 30 + 4 * 10
    s = footprint.footprint_summary(cells(values), g, 10, "value").first()
    assert (s.n_blocks, s.area, s.xmin, s.xmax, s.ymin, s.ymax) == (8, 800.0, 0.0, 30.0, 0.0, 30.0)


def test_long_edges_merge_across_chunks(spark):
    units = spark.range(25).filter("id <> 13").select(
        F.lit("h").alias("axis"), F.lit(2).cast("bigint").alias("line"), F.col("id").alias("pos")
    )
    got = {(s.start, s.end) for s in footprint.merge_edges(units, chunk=4).collect()}
    assert got == {(0, 13), (14, 25)}


def test_presence_is_a_share_of_the_cells_of_the_grid(spark):
    """Ten cells of a 10 x 10 block have rows: the cover fraction is 0.1, and a block cut by the edge counts its cells."""
    from pyspark.sql import functions as F

    from cellframe.plans.layers import STACK, modelling_table

    grid = Grid(0.0, 100.0, 1.0, 1.0, 15, 10)
    rows = [(0, c, 1.0) for c in range(10)] + [(12, 0, 1.0)]
    cells = spark.createDataFrame(rows, "r bigint, c bigint, cover_fraction double")
    stack = cells.select("r", "c", *[F.col("cover_fraction").alias(n) if n == "cover_fraction" else F.lit(1.0).alias(n) for n in STACK])
    out = {x.r: x.cover_fraction for x in modelling_table(stack, grid, 10).collect()}
    assert out == {0: 0.1, 1: 1 / 50}


def test_damage_needs_elevation_and_sites_outside_have_no_count(spark):
    from cellframe.plans.layers import damage_by_year, site_damage

    grid = Grid(0.0, 10.0, 1.0, 1.0, 10, 10)
    first = spark.createDataFrame([(0, 0, 2000), (0, 1, 2000), (0, 2, 2000)], "r bigint, c bigint, first_year int")
    cover = spark.createDataFrame([(0, 0, 0, 5.0), (0, 1, 0, None), (0, 2, 1, 5.0)], "r bigint, c bigint, cover int, elev double")
    out = {x.variable: x.n_cells for x in damage_by_year(first, cover, grid, [2000]).collect()}
    assert out == {"in_cover": 1, "out_cover": 1}
    sites = spark.createDataFrame([("in", 0.5, 9.5), ("none", 5.5, 5.5), ("out", 99.0, 99.0)], "site_code string, x double, y double")
    years = spark.createDataFrame([(0, 0, 3)], "r bigint, c bigint, n_years bigint")
    heights = spark.createDataFrame([(0, 0, -5.0)], "r bigint, c bigint, dh double")
    got = {x.site_code: (x.damage_survey_years, x.damage_survey) for x in site_damage(sites, years, heights, grid).collect()}
    assert got == {"in": (3, True), "none": (0, False), "out": (None, False)}
