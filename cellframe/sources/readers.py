"""Readers for layers, yearly stacks, polygons, CSV tables and saved results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe.functions.algebra import null_if_nan
from cellframe.functions.text import year_from_name
from cellframe.operators.polygons import RINGS_DDL
from cellframe.operators.stack import union_all

LAYER_SCHEMA = T.StructType(
    [
        T.StructField("r", T.LongType()),
        T.StructField("c", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """One layer as (r, c, value); NaN becomes NULL. Row and column filters reach the scan."""
    df = spark.read.parquet(path)
    return df.select("r", "c", null_if_nan(F.col("value").cast("double")).alias("value"))


def read_window(
    spark: SparkSession, path: str, tile: int, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None
) -> DataFrame:
    """(r, c, value) of a tiled store, cut to first and last row and column; tiles outside are not opened.

    ``tile`` is the side that the store was written with."""
    df = spark.read.parquet(path)
    for axis, span in (("r", rows), ("c", cols)):
        if span is not None:
            first, last = span
            df = df.filter(F.col(f"tile_{axis}").between(first // tile, last // tile) & F.col(axis).between(first, last))
    return df.select("r", "c", null_if_nan(F.col("value").cast("double")).alias("value"))


def read_layers(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Named layers as one long table (layer, r, c, value)."""
    return union_all([read_layer(spark, p).select(F.lit(n).alias("layer"), "r", "c", "value") for n, p in paths.items()])


def read_yearly_stack(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All yearly layers under a path pattern, the year taken from each file's name.

    One scan for all years; files whose names carry no year are left out."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.schema(LAYER_SCHEMA).option("recursiveFileLookup", "true").parquet(*paths)
    return (
        df.select(
            year_from_name(F.col("_metadata.file_path")).alias("year"),
            "r",
            "c",
            null_if_nan(F.col("value")).alias("value"),
        )
        .filter("year IS NOT NULL")
    )


def normalize_polygons(df: DataFrame, year: int | None = None) -> DataFrame:
    """(poly_id, year, host_code, area, rings) whatever the survey year called its columns."""
    names = {c.lower(): c for c in df.columns}
    hosts = [F.col(names[n]) for n in ("host1", "host_code") if n in names]
    area = F.col(names["area"]).cast("double") if "area" in names else F.lit(None).cast("double")
    return df.select(
        F.col(names["poly_id"]).cast("bigint").alias("poly_id"),
        (F.lit(year) if year is not None else F.col(names["year"])).cast("int").alias("year"),
        (F.coalesce(*hosts) if hosts else F.lit(None)).cast("int").alias("host_code"),
        area.alias("area"),
        F.col(names["rings"]).cast(RINGS_DDL).alias("rings"),
    )


def read_polygons(spark: SparkSession, paths_by_year: Mapping[int, str]) -> DataFrame:
    """Survey polygons of several years in one table."""
    return union_all([normalize_polygons(spark.read.parquet(p), year) for year, p in paths_by_year.items()])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header line and a given schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_csv_plain(spark: SparkSession, path: str, names: Sequence[str], type_name: str = "double") -> DataFrame:
    """CSV without a header line; the column names are supplied."""
    return spark.read.schema(", ".join(f"`{n}` {type_name}" for n in names)).csv(path)


def read_crosstab(spark: SparkSession, path: str, label: str = "label") -> DataFrame:
    """CSV cross table: a blank first heading over the row labels, counts in the other
    columns, with or without a byte-order mark."""
    df = spark.read.option("header", True).csv(path)
    first, *rest = df.columns
    return df.select(F.col(f"`{first}`").alias(label), *[F.col(f"`{c}`").cast("bigint").alias(c) for c in rest])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A saved result or gazetteer table."""
    return spark.read.parquet(path)
