"""Running totals inside groups of any size: ranges of sorted rows, local totals, and what each range continues."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe.spark import settle

#: Most rows that a range has in the mean; more ranges are made beyond it.
RANGE_ROWS = 100_000


def _local(batches: Iterator[pa.RecordBatch], key: Sequence[str], totals: Mapping[str, tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Totals of a sorted range by itself; ``lead`` marks rows of its first group."""
    last: list[int] | None = None
    carry = dict.fromkeys(totals, 0)
    leading = True
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in key]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        now = [k[-1] for k in keys]
        new[0] = last is not None and any(k[0] != p for k, p in zip(keys, last, strict=True))
        heads = np.r_[0, np.flatnonzero(new[1:]) + 1]
        sizes = np.diff(np.r_[heads, batch.num_rows])
        changes = np.cumsum(new)
        columns = list(batch.columns)
        for name, (source, kind) in totals.items():
            v = batch.column(batch.schema.get_field_index(source)).to_numpy(zero_copy_only=False).astype(np.int64)
            if kind == "xor":
                run = np.bitwise_xor.accumulate(v)
                before = run[heads] ^ v[heads]
                before[0] = 0 if new[0] else carry[name]
                out = run ^ np.repeat(before, sizes)
            else:
                run = np.cumsum(v)
                before = v[heads] - run[heads]
                before[0] = 0 if new[0] else carry[name]
                out = run + np.repeat(before, sizes)
            carry[name] = int(out[-1])
            columns.append(pa.array(out))
        lead = (changes == 0) & leading
        leading = bool(lead[-1])
        last = now
        yield pa.RecordBatch.from_arrays([*columns, pa.array(lead)], names=[*batch.schema.names, *totals, "lead"])


def running(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, tuple[str, str]],
    deal: Sequence[str] | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``keep`` (all) columns of ``df`` with inclusive running totals inside each group of ``key`` (non-null integers) in the order of ``order``.

    ``totals`` maps a new column to (column, 'sum' or 'xor'). Rows are dealt by ranges of key and order, so a group may
    span any number of tasks; a task keeps one row's totals. What a range continues from earlier ones is a table of at
    most two rows a range. Rows that tie are taken in any order, once: the result is written. ``df`` is counted and read twice. ``deal`` names columns to form ranges
    by in place of ``order``: short ones that it sorts alike, for rows with long texts."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    keep = list(keep or df.columns)
    carried = list(dict.fromkeys([*keep, *key, *(c for c, _ in totals.values())]))
    schema = T.StructType([*[df.schema[c] for c in carried], T.StructField("range", T.LongType()), *[T.StructField(n, T.LongType()) for n in totals], T.StructField("lead", T.BooleanType())])
    ranged = df.repartitionByRange(parts, *key, *(deal or order)).withColumn("range", F.spark_partition_id().cast("long"))
    ranged = ranged.sortWithinPartitions(*key, *order).select(*carried, "range")
    local = settle(ranged.mapInArrow(lambda batches: _local(batches, key, totals), schema))
    kinds = {"sum": F.sum, "xor": F.bit_xor}
    led = F.broadcast(local.filter("lead").select(*key).distinct())  # one group a range at most
    parts_of = local.join(led, list(key)).groupBy(*key, "range").agg(*[kinds[k](c).alias(f"_{n}") for n, (c, k) in totals.items()])
    earlier = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = settle(parts_of.select(*key, "range", *[F.coalesce(kinds[k](f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n, (_, k) in totals.items()]), small=True)
    out = local.join(F.broadcast(before), [*key, "range"], "left")  # two groups a range at most
    for n, (_, k) in totals.items():
        add = F.coalesce(F.col(f"_{n}"), F.lit(0))
        out = out.withColumn(n, F.col(n).bitwiseXOR(add) if k == "xor" else F.col(n) + add)
    return out.select(*keep, *totals)
