"""Shared pieces: reading the tables, running a function of rows inside tasks, hashes of runs of words."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task turns into Python objects at a time.
STEP = 256

_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
    "array<float>": pa.list_(pa.float32()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table, cut to the columns in use, so that others never reach an operator."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def arrow_fields(schema: str) -> list[tuple[str, pa.DataType]]:
    """('doc_id long, text string') as Arrow names and types."""
    pairs = [p.split() for p in schema.split(",")]
    return [(name, _ARROW[kind]) for name, kind in pairs]


def arrow_batch(fields: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    arrays = [pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[..., Iterable[tuple]]], step: int = STEP) -> DataFrame:
    """Rows of ``df`` through Python: ``start()`` runs once a task and gives ``f(*row)``, which gives output rows.

    A task holds ``step`` rows as Python objects, whatever Spark's batches are."""
    fields = arrow_fields(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out: list[tuple] = []
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    out.extend(f(*row))
                if out:
                    yield arrow_batch(fields, out)

    return df.mapInArrow(run, schema)


_KEPT: dict = {}


def kept(key: object, build: Callable[[], object]):
    """What ``build`` gives, built once in each Python worker. A worker keeps one such model: that of another operator
    goes when the next is built, so the stages of a pipeline do not pile theirs up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


#: Rows of an Arrow batch between the JVM and Python for tables of whole texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's 10,000 rows, for stages that carry whole texts; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def id_crc(column: str = "doc_id"):
    """crc32 of an id as text: the fixed rule that sets labelled rows aside."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def py_id_crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


# ---- 64-bit hashes of words and of runs of words, over whole Arrow buffers at once ----

_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64. Tables up to KEPT stay in the worker."""

    KEPT = 1 << 21

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.KEPT:
            return _powers(self.base, n), _powers(self.inverse, n)
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up[:n], self.down[:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[start:end] for each pair: prefix sums of value * base**i, shifted back to the start."""
    up, down = powers.upto(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of one batch of texts: runs of bytes other than space, tab to carriage return.

    ``start``/``end`` are byte offsets in ``data``; ``doc`` is each word's text number, ``first[d]:first[d + 1]`` are
    the words of text d. ``hash`` has one 64-bit hash of each word."""

    def __init__(self, texts: pa.Array, powers: tuple[Powers, ...]):
        texts = texts.cast(pa.string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        raw = texts.buffers()[2]
        whole = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]] if n else whole[:0]
        offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
        space = _SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[offsets[:-1]] = True
        inside = ~space
        before = np.concatenate([[True], space]) if len(space) else np.ones(1, bool)
        starts = inside & (before[:-1] | edge[:-1])
        after = np.concatenate([space[1:], [True]]) if len(space) else space
        ends = inside & (after | np.concatenate([edge[1:-1], [True]])) if len(space) else inside
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.offsets = offsets
        byte = self.data.astype(np.uint64) + np.uint64(1)
        self.hashes = [run_hashes(byte, self.start, self.end, p) for p in powers]

    @property
    def hash(self) -> np.ndarray:
        return self.hashes[0]


BYTE_POWERS = (Powers(_MULT[0]), Powers(_MULT[1]))
WORD_POWERS = (Powers(np.uint64(0xD6E8FEB86659FD93)), Powers(np.uint64(0xA0761D6478BD642F)))

ANY_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def text_slices(batches: Iterable[pa.RecordBatch], column: int, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows whose text column has about ``max_bytes`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto
