"""Substring dedup by relative Lempel-Ziv parsing over content-defined reference blocks.

The whole corpus is the reference. Every run of WINDOW words has an anchor, the smallest hashed gram of GRAM words in it;
the windows of one anchor, side by side, make a block of words, so block borders depend on content only and equal
passages are cut alike wherever they stand. Blocks are the index: a block whose content stands earlier in the corpus is
copied whole, and the greedy parse of a document strings such blocks to factors. Only at the borders of factors, where a
block shares its anchor with blocks of other content, are single windows held against each other. The result is exact:
a word goes if and only if a window of WINDOW words over it also starts earlier (smaller doc_id, then earlier start).

Most anchors occur once; a first pass counts them, and only blocks of repeated anchors go on, so what is shuffled grows
with the text divided by the anchors' spacing, and a passage that a third of all rows share is counted before it moves.
Hashes of blocks are 128 bits with their anchor, those of windows 128 bits.

Words are runs of bytes other than space and tab to carriage return. Null text has no words; texts shorter than a window
keep all; of repeated rows with one id the first read counts as the earlier; null ids come first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import BYTE_POWERS, WORD_POWERS, Words, arrow_fields, map_rows, run_hashes, sha256_hex, text_slices
from cellframe.spark import settle

WINDOW, GRAM = 20, 8
#: Most repeated anchors, 8 bytes each, that are sent to every task; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 2_000_000
_PLACE = np.uint64((1 << 28) - 1)


class Blocks:
    """Blocks of the texts of one batch: anchor hash, block hash, row, first window and number of windows."""

    def __init__(self, texts: pa.Array, window: int = WINDOW, gram: int = GRAM):
        self.words = w = Words(texts, BYTE_POWERS)
        self.window = window
        n = len(w.start)
        self.row = self.first = self.count = np.zeros(0, np.int64)
        self.anchor = self.block = np.zeros(0, np.uint64)
        if n < window:
            return
        grams = np.arange(n - gram + 1)
        g = run_hashes(w.hashes[0], grams, grams + gram, WORD_POWERS[0])
        least = (g & ~_PLACE) | grams.astype(np.uint64)  # hash first, then the leftmost
        span = window - gram + 1
        size = 1
        while size < span:
            step = min(size, span - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        starts = np.arange(n - window + 1)
        place = (least[: len(starts)] & _PLACE).astype(np.int64)
        doc = w.doc[: len(starts)]
        whole = starts + window <= w.first[doc + 1]
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
        new &= whole
        at = np.flatnonzero(new)
        ends = np.flatnonzero(whole & np.r_[new[1:] | ~whole[1:], True]) if len(at) else at
        self.anchor = g[place[at]]
        self.block = run_hashes(w.hashes[1], at, ends + window, WORD_POWERS[1])
        self.row = doc[at]
        self.first = at - w.first[self.row]
        self.count = ends - at + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, 0):
        yield pa.RecordBatch.from_arrays([_signed(Blocks(part.column(0)).anchor)], names=["a"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, 2):
        b = Blocks(part.column(2))
        row = pa.array(b.row)
        columns = [_signed(b.anchor), _signed(b.block), part.column(0).take(row), part.column(1).take(row), pa.array(b.first.astype(np.int32)), pa.array(b.count.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "c", "doc_id", "rid", "at", "n"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of the asked windows of each text."""
    fields = arrow_fields("w1 long, w2 long, doc_id long, rid long, at int")
    for part in text_slices(batches, 2):
        w = Words(part.column(2), BYTE_POWERS)
        starts, rows = [], []
        for k, (ats, ns) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
            for at, n in zip(ats, ns, strict=True):
                starts.append(np.arange(at, at + n) + w.first[k])
                rows.append(np.full(n, k))
        s, r = np.concatenate(starts), np.concatenate(rows)
        h = [_signed(run_hashes(w.hashes[i], s, s + WINDOW, WORD_POWERS[i])) for i in (0, 1)]
        row = pa.array(r)
        columns = [*h, part.column(0).take(row), part.column(1).take(row), pa.array((s - w.first[r]).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=[f for f, _ in fields])


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, rid, text: rows numbered and written once, so that every later reading has the same numbers."""
    return settle(docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text"))


def duplicate_spans(rows: DataFrame) -> DataFrame:
    """rid, at, to: runs of words [at, to) of numbered rows that are covered by windows which start earlier elsewhere."""
    anchors = rows.select("text").filter("text is not null").mapInArrow(_anchors, "a long")
    repeated = settle(anchors.groupBy("a").agg(F.count("*").alias("k")).filter("k > 1").select("a"))
    if repeated.count() <= MAX_BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    blocks = rows.select("doc_id", "rid", "text").filter("text is not null").mapInArrow(_blocks, "a long, c long, doc_id long, rid long, at int, n int")
    blocks = settle(blocks.join(repeated, "a"))
    place = F.struct("doc_id", "rid", "at")
    firsts = settle(blocks.groupBy("a", "c").agg(F.min(F.struct("doc_id", "rid", "at", "n")).alias("first")))
    copied = blocks.join(firsts.select("a", "c", F.struct("first.doc_id", "first.rid", "first.at").alias("first")), ["a", "c"]).filter(place != F.col("first"))
    copied = copied.select("rid", "at", (F.col("at") + F.col("n") - 1 + WINDOW).alias("to"))
    # borders of factors: one anchor, several contents
    several = firsts.groupBy("a").agg(F.count("*").alias("k")).filter("k > 1").select("a")
    border = firsts.join(several, "a", "left_semi").select("first.*")
    asked = border.groupBy("rid").agg(F.collect_list("at").alias("ats"), F.collect_list("n").alias("ns"))
    windows = rows.join(asked, "rid").select("doc_id", "rid", "text", "ats", "ns").mapInArrow(_windows, "w1 long, w2 long, doc_id long, rid long, at int")
    windows = settle(windows)
    earliest = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("k")).filter("k > 1").select("w1", "w2", "first")
    single = windows.join(earliest, ["w1", "w2"]).filter(place != F.col("first")).select("rid", "at", (F.col("at") + WINDOW).alias("to"))
    return copied.unionByName(single)


def _kept(text: str | None, ats: list[int] | None, tos: list[int] | None) -> tuple[list[bytes], int]:
    words = (text or "").encode().split()
    if not ats:
        return words, 0
    keep, at = [], 0
    for a, t in sorted(zip(ats, tos, strict=True)):
        if a > at:
            keep += words[at:a]
        at = max(at, t)
    keep += words[at:]
    return keep, len(words) - len(keep)


def _with_spans(docs: DataFrame) -> DataFrame:
    rows = numbered(docs)
    spans = duplicate_spans(rows).groupBy("rid").agg(F.collect_list("at").alias("ats"), F.collect_list("to").alias("tos"))
    return rows.join(spans, "rid", "left").select("doc_id", "text", "ats", "tos")


def removed_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of (doc_id, text)."""

    def start():
        def row(doc_id, text, ats, tos):
            keep, removed = _kept(text, ats, tos)
            return [(doc_id, len(keep) + removed, removed, sha256_hex(b" ".join(keep)))]

        return row

    return map_rows(_with_spans(docs), "doc_id long, n_words long, n_removed long, kept_sha256 string", start)


def remove_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text with duplicate spans removed: kept words joined by one space."""

    def start():
        return lambda doc_id, text, ats, tos: [(doc_id, None if text is None else b" ".join(_kept(text, ats, tos)[0]).decode())]

    return map_rows(_with_spans(docs), "doc_id long, text string", start)
