import hashlib

import pytest
from pyspark.sql import functions as F

from cellframe.operators import sampling as M
from cellframe.operators import spatial_blocks as SB


def h(i, seed):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest()


@pytest.mark.parametrize("size", [0, 1, 7, 500, 999, 1000, 5000])
def test_uniform_sample_is_the_first_hashes(spark, size):
    got = sorted(r.id for r in M.sample_rows(spark.range(1000), "id", size, 4).collect())
    assert got == sorted(sorted(range(1000), key=lambda i: h(i, 4))[:size])


def test_sample_does_not_depend_on_layout(spark):
    base = M.sample_rows(spark.range(2000), "id", 300, 9).orderBy("id").collect()
    for n in (1, 4, 17):
        assert M.sample_rows(spark.range(2000).repartition(n), "id", 300, 9).orderBy("id").collect() == base


def test_balanced_sample_with_a_dominant_class(spark):
    df = spark.range(3000).withColumn("y", F.when(F.col("id") % 100 == 0, "rare").otherwise("common"))
    out = {r.y: r["count"] for r in M.sample_balanced(df, "id", "y", 2).groupBy("y").count().collect()}
    assert out == {"rare": 15, "common": 15}
    many = df.withColumn("y", F.col("id") % 3)
    halved = {r.y: r["count"] for r in M.sample_balanced(many, "id", "y", 2, divide_by=2).groupBy("y").count().collect()}
    assert halved == {0: 500, 1: 500, 2: 500}
    assert M.sample_balanced(many, "id", "y", 2, size=30).count() == 30


def frame(spark, n=40):
    return spark.range(n * n).select(
        F.col("id").alias("cell_id"),
        ((F.col("id") % n) * 10 + 5.0).alias("x"),
        (F.floor(F.col("id") / n) * 10 + 5.0).alias("y"),
    )


def test_block_ids_are_dense_and_in_label_order(spark):
    df = SB.with_block_ids(frame(spark), 100.0)
    assert df.count() == 1600
    ids = df.select("grid_id", "x_grid", "y_grid").distinct().orderBy("grid_id").collect()
    assert [r.grid_id for r in ids] == list(range(1, len(ids) + 1))
    labels = [(r.x_grid, r.y_grid) for r in ids]
    assert labels == sorted(labels)
    # 40 columns at 5..395: breaks 5,105,205,305 -> three blocks, lowest column and overflow are NA
    xs = {r.x_grid: r["count"] for r in df.groupBy("x_grid").count().collect()}
    assert xs == {"(5.00,105.00]": 400, "(105.00,205.00]": 400, "(205.00,305.00]": 400, "NA": 400}


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.8, 1.0])
def test_split_is_disjoint_exhaustive_and_sized(spark, fraction):
    df = SB.with_block_ids(frame(spark), 50.0)
    train, test = SB.split_blocks(df, fraction, 3)
    a = {r.grid_id for r in train.select("grid_id").distinct().collect()}
    b = {r.grid_id for r in test.select("grid_id").distinct().collect()}
    top = df.agg(F.max("grid_id")).first()[0]
    assert not a & b and a | b == set(range(1, top + 1))
    assert len(a) == int(fraction * top)
    assert train.count() + test.count() == df.count()


def test_split_counts_ids_without_rows(spark):
    df = spark.createDataFrame([(1,), (10,)], "grid_id bigint")
    train, test = SB.split_blocks(df, 0.8, 1)
    order = sorted(range(1, 11), key=lambda i: h(i, 1))[:8]
    assert {r.grid_id for r in train.collect()} == {1, 10} & set(order)
    assert train.count() + test.count() == 2


def test_difference_and_complete_columns(spark):
    ids = spark.range(5).withColumnRenamed("id", "grid_id")
    assert {r.grid_id for r in SB.block_lists(ids, ids.filter("grid_id > 2")).collect()} == {0, 1, 2}
    df = spark.createDataFrame([(1.0, None, "a"), (2.0, 3.0, None)], "x double, y double, z string")
    assert SB.complete_columns(df, ["x", "y", "absent"]).collect() == [(2.0, 3.0)]
