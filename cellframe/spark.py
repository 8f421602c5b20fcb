"""Helpers around the session: settled intermediate tables, size-checked lookups, long ranges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.grid import int_div

MAX_BROADCAST_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for settled tables: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own (tests)."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="cellframe-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame, small: bool = False) -> DataFrame:
    """Compute once into the shared checkpoint folder.

    It cuts the lineage, so a lost executor costs a re-read, and repeated uses see the very
    same rows. A frame becomes a parquet table: later uses read only the columns they need,
    and Spark sees its real size. ``small`` lookups take the lighter plain checkpoint."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if small:
        return df.checkpoint(eager=True)
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
    settled: bool = False,
) -> DataFrame:
    """Join a small derived table to a big one without shuffling the big side.

    The lookup is settled (unless it is already) and counted first, and broadcast only
    within ``max_rows``.
    Beyond that Spark picks a shuffled join, where AQE splits hot keys."""
    if not settled:
        lookup = settle(lookup, small=True)
    if lookup.count() <= max_rows:
        lookup = F.broadcast(lookup)
    return df.join(lookup, list(on), how)


def explode_range(df: DataFrame, lo: Column, hi: Column, name: str, chunk: int = 4096) -> DataFrame:
    """One row per integer in [lo, hi]. Long ranges go through chunks, so that no array
    grows with the data."""
    df = df.withColumns({"_from": lo.cast("bigint"), "_to": hi.cast("bigint")}).filter("_from <= _to")
    df = df.withColumn("_part", F.explode(F.sequence(_floor_div("_from", chunk), _floor_div("_to", chunk))))
    first = F.greatest(F.col("_from"), F.col("_part") * chunk)
    last = F.least(F.col("_to"), F.col("_part") * chunk + (chunk - 1))
    return df.withColumn(name, F.explode(F.sequence(first, last))).drop("_from", "_to", "_part")


def _floor_div(col: str, by: int) -> Column:
    v = F.col(col)
    return int_div(v - F.pmod(v, F.lit(by)), by)
