"""Writers for layers, outlines, CSV summaries and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.operators.blocks import with_tile

# Raster storage types with their Spark type and value range.
STORAGE = {
    "INT1S": ("tinyint", -127, 127),
    "INT1U": ("smallint", 0, 255),
    "INT2S": ("smallint", -32767, 32767),
    "INT2U": ("int", 0, 65535),
    "INT4S": ("int", -2147483647, 2147483647),
    "FLT4S": ("float", None, None),
    "FLT8S": ("double", None, None),
}


def to_storage(value: Column, datatype: str) -> Column:
    """Cast to a storage type; a value outside its range stops the job instead of wrapping."""
    spark_type, lo, hi = STORAGE[datatype]
    if lo is None:
        return value.cast(spark_type)
    bad = value.isNotNull() & ~value.between(lo, hi)
    message = F.concat(F.lit(f"value outside {datatype}: "), value.cast("string"))
    return F.when(bad, F.raise_error(message).cast(spark_type)).otherwise(value.cast(spark_type))


def write_layer(df: DataFrame, path: str, datatype: str = "FLT8S", tile: int = 1000, overwrite: bool = True) -> None:
    """Write (r, c, value), clustered by tile so that a window read touches few row groups.

    Rows are range-partitioned and sorted by tile: files stay of even size, and their r/c
    statistics let the scan skip what a crop does not need."""
    out = with_tile(df.select("r", "c", to_storage(F.col("value"), datatype).alias("value")), tile)
    out = out.repartitionByRange("tile_r", "tile_c", "r").sortWithinPartitions("tile_r", "tile_c", "r", "c")
    out.drop("tile_r", "tile_c").write.mode("overwrite" if overwrite else "errorifexists").option(
        "compression", "zstd"
    ).parquet(path)


def write_tiled(df: DataFrame, path: str, tile: int = 1000, datatype: str = "FLT8S", overwrite: bool = True) -> None:
    """Write (r, c, value) with a folder per square tile, so that a window read opens the files of its tiles only; inside
    them rows are in order, and row-group statistics skip what the window does not reach."""
    out = with_tile(df.select("r", "c", to_storage(F.col("value"), datatype).alias("value")), tile)
    out = out.repartitionByRange("tile_r", "tile_c", "r").sortWithinPartitions("tile_r", "tile_c", "r", "c")
    writer = out.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("tile_r", "tile_c")
    writer.option("compression", "zstd").parquet(path)


def write_yearly_layers(df: DataFrame, path: str, datatype: str = "INT2U") -> None:
    """Write (year, r, c, value) as one folder per year named ``Year=<year>``."""
    out = df.select(F.col("year").alias("Year"), "r", "c", to_storage(F.col("value"), datatype).alias("value"))
    out.repartitionByRange("Year", "r").sortWithinPartitions("Year", "r", "c").write.mode("overwrite").partitionBy(
        "Year"
    ).option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no row names."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result, outline, vertex or partial-dependence table as parquet."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)
