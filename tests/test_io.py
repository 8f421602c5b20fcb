import glob

import pytest
from pyspark.sql import functions as F

from cellframe.sources import readers as R
from cellframe.sources import writers as W


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_layer_round_trip_and_pushdown(spark, cells, folder):
    df = cells({(r, c): r * 100 + c for r in range(30) for c in range(20)})
    W.write_layer(df, f"{folder}/a", tile=8)
    back = R.read_layer(spark, f"{folder}/a")
    assert sorted(back.collect()) == sorted(df.collect())
    plan = back.filter("r BETWEEN 3 AND 5 AND c < 4").select("value")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(r,3)" in plan and "LessThan(c,4)" in plan
    two = R.read_layers(spark, {"a": f"{folder}/a", "b": f"{folder}/a"})
    assert two.groupBy("layer").count().count() == 2


def test_window_read_opens_the_files_of_its_tiles(spark, cells, folder):
    df = cells({(r, c): r * 100 + c for r in range(40) for c in range(60)})
    W.write_tiled(df, f"{folder}/t", tile=10, datatype="INT2U")
    assert sorted(R.read_window(spark, f"{folder}/t", 10).collect()) == sorted(df.collect())
    window = R.read_window(spark, f"{folder}/t", 10, (8, 12), (33, 35))
    assert sorted((x.r, x.c) for x in window.collect()) == [(r, c) for r in range(8, 13) for c in range(33, 36)]
    plan = window._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "tile_r" in text.split("PartitionFilters")[1].split("]")[0] and "GreaterThanOrEqual(r,8)" in text

    for file in glob.glob(f"{folder}/t/tile_r=[123]/tile_c=[0-2]/*.parquet") + glob.glob(f"{folder}/t/tile_r=3/tile_c=3/*.parquet"):
        with open(file, "wb") as f:
            f.write(b"not a table")
    assert R.read_window(spark, f"{folder}/t", 10, (8, 12), (33, 35)).count() == 15  # other tiles' files stay closed
    with pytest.raises(Exception, match="FAILED_READ_FILE|parquet|Parquet"):
        R.read_window(spark, f"{folder}/t", 10, (8, 12), (25, 35)).collect()


def test_nan_is_read_as_null(spark, folder):
    spark.createDataFrame([(0, 0, float("nan")), (0, 1, 2.0)], "r bigint, c bigint, value double").write.parquet(f"{folder}/n")
    assert R.read_layer(spark, f"{folder}/n").agg(F.count("value"), F.avg("value")).first() == (1, 2.0)


@pytest.mark.parametrize("datatype,value,ok", [("INT1S", 127, True), ("INT1S", 2004, False), ("INT2U", 65535, True), ("INT2U", -1, False), ("INT1U", 255, True), ("FLT4S", 2004, True)])
def test_storage_range_is_checked(spark, cells, folder, datatype, value, ok):
    df = cells({(0, 0): value, (0, 1): None})
    if ok:
        W.write_layer(df, f"{folder}/s", datatype)
        assert R.read_layer(spark, f"{folder}/s").agg(F.max("value")).first()[0] == value
    else:
        with pytest.raises(Exception, match="outside"):
            W.write_layer(df, f"{folder}/s", datatype)


def test_overwrite_replaces(spark, cells, folder):
    W.write_layer(cells({(0, 0): 1, (0, 1): 2}), f"{folder}/o")
    W.write_layer(cells({(5, 5): 3}), f"{folder}/o")
    assert R.read_layer(spark, f"{folder}/o").collect() == [(5, 5, 3.0)]
    with pytest.raises(Exception):
        W.write_layer(cells({(5, 5): 3}), f"{folder}/o", overwrite=False)


def test_yearly_stack_from_folders_and_file_names(spark, cells, folder):
    y = spark.createDataFrame([(2000, 0, 0, 1.0), (2001, 0, 0, 1.0), (2001, 1, 2, 1.0)], "year int, r bigint, c bigint, value double")
    W.write_yearly_layers(y, f"{folder}/y")
    back = R.read_yearly_stack(spark, f"{folder}/y")
    assert sorted((r.year, r.r, r.c, r.value) for r in back.collect()) == sorted(tuple(r) for r in y.collect())
    for name in ("r_damage_Year.2003.parquet", "r_damage_Year.2004.parquet", "r_damage_summed.parquet"):
        cells({(1, 1): 1}).write.parquet(f"{folder}/z/{name}")
    assert {r.year for r in R.read_yearly_stack(spark, f"{folder}/z/*").collect()} == {2003, 2004}


def test_csv_kinds(spark, folder):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "", None)], "i int, s string, v double")
    W.write_csv(df.coalesce(1), f"{folder}/c")
    back = R.read_csv(spark, f"{folder}/c", "i int, s string, v double").collect()
    assert [(r.i, r.v) for r in back] == [(1, 2.5), (2, None)]
    with open(f"{folder}/w.txt", "w") as f:
        f.write("381.3\n386.3\n")
    assert [r.V1 for r in R.read_csv_plain(spark, f"{folder}/w.txt", ["V1"]).collect()] == [381.3, 386.3]


@pytest.mark.parametrize("mark", ["﻿", ""])
def test_crosstab_with_blank_heading(spark, folder, mark):
    with open(f"{folder}/x.csv", "w", encoding="utf-8") as f:
        f.write(mark + ",observed triploid,observed diploid\npredicted triploid,533,113\npredicted diploid,104,747")
    m = R.read_crosstab(spark, f"{folder}/x.csv", "X")
    assert m.columns == ["X", "observed triploid", "observed diploid"]
    assert sorted(tuple(r) for r in m.collect()) == [("predicted diploid", 104, 747), ("predicted triploid", 533, 113)]


def test_polygons_and_tables_round_trip(spark, folder):
    rings = "array<struct<hole: boolean, pts: array<struct<x: double, y: double>>>>"
    shape = [(False, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])]
    spark.createDataFrame([(1, 746, shape)], f"poly_id bigint, HOST1 int, rings {rings}").write.parquet(f"{folder}/p16")
    spark.createDataFrame([(2, 746, 9.0, shape)], f"poly_id bigint, HOST_CODE int, Area double, rings {rings}").write.parquet(f"{folder}/p18")
    p = R.read_polygons(spark, {2016: f"{folder}/p16", 2018: f"{folder}/p18"})
    assert sorted((r.poly_id, r.year, r.host_code, r.area) for r in p.collect()) == [(1, 2016, 746, None), (2, 2018, 746, 9.0)]
    W.write_table(p.drop("rings"), f"{folder}/t")
    W.write_table(p.drop("rings"), f"{folder}/t", "append")
    assert R.read_table(spark, f"{folder}/t").count() == 4
