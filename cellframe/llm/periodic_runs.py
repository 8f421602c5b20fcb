"""Periodic runs of words: the branching-tandem test on an enhanced suffix array.

The texts of one slice stand side by side, a sentinel of its own after each, and words carry their text in their first
rank, so that no suffix matches one of another text. Prefix doubling sorts the suffixes; the ranks of each doubling are
kept, and the common prefix of any two suffixes is read off them. Every interval of the LCP array with value d has
children cut at its places of value d; for the suffixes i of all children but the largest, ISA[i + d] and ISA[i - d] are
looked up: inside the interval and outside the child, the two suffixes share exactly d words, and there is a square of
period d that no further word continues. A square is rotated to the left as far as words agree, which gives the run;
squares of multiples of a period give the same stretch, of which the smallest period stays. Intervals come from nearest
smaller values, all at once; there is no tree. All suffixes that are looked up are at most n log n.

A word that stands fewer than ``exponent`` times in its text is in no run and counts as a sentinel, and an interval with
fewer suffixes holds none, which changes no result.

A run is a stretch with smallest period q and at least max(least, exponent * q) words that no neighbouring word extends.
Words are runs of bytes other than space and tab to carriage return. Null and empty texts have no words and no runs;
repeated rows give repeated results; an empty table gives an empty one; columns other than the two named are not read.
Every text is read whole; a task holds about a megabyte of text, or one longer text, with some hundred bytes a word."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellframe.llm.common import BYTE_POWERS, Words, arrow_batch, arrow_fields, py_id_crc, text_slices

#: Fewest words of a run and fewest repeats of its period.
LEAST, EXPONENT = 6, 4


def word_numbers(words: Words) -> np.ndarray:
    """Equal numbers for equal words (by two 64-bit hashes)."""
    h, other = words.hashes
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    if (other != other[first][number]).any():
        _, number = np.unique(np.stack([h, other]), axis=1, return_inverse=True)
    return number.reshape(-1).astype(np.int64)


class SuffixArray:
    """Sorted suffixes of several sequences of numbers, with the ranks of every doubling.

    ``first[d]:first[d + 1]`` are the symbols of sequence d. Places count one sentinel after each sequence. Only suffixes
    whose first symbol stands ``often`` times in its sequence are sorted; the others match nothing."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, often: int = 1):
        n, sequences = len(symbols), len(first) - 1
        doc = np.repeat(np.arange(sequences), np.diff(first))
        self.size = n + sequences
        self.begin = first[:-1] + np.arange(sequences)
        key = doc * (int(symbols.max(initial=0)) + 1) + symbols
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]] if n else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        count = np.bincount(group, minlength=1)
        kept = count[group] >= often
        self.order = sa = (order + doc[order])[kept]
        m = len(sa)
        rank = np.arange(m, m + self.size)
        heads = np.flatnonzero(new[kept])
        sizes = np.diff(np.r_[heads, m])
        rank[sa] = np.repeat(heads, sizes)
        self.widest = int(sizes.max(initial=0))
        self.levels = [rank.astype(np.int32)]
        open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
        step = 1
        while len(open_):
            places = sa[open_]
            both = rank[places] * (m + self.size) + rank[places + step]
            order = np.argsort(both)
            both, places = both[order], places[order]
            sa[open_] = places
            new = np.r_[True, both[1:] != both[:-1]]
            at = np.flatnonzero(new)
            sizes = np.diff(np.r_[at, len(open_)])
            rank[places] = np.repeat(open_[at], sizes)
            self.levels.append(rank.astype(np.int32))
            open_ = open_[np.repeat(sizes > 1, sizes)]
            step *= 2
        self.inverse = np.full(self.size, -1)
        self.inverse[sa] = np.arange(m)
        self.lcp = np.zeros(m + 1, np.int64)
        same = np.flatnonzero(self.levels[0][sa[1:]] == self.levels[0][sa[:-1]]) + 1 if m else np.zeros(0, np.int64)
        self.lcp[same] = self.common(sa[same - 1], sa[same])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes at different places i and j."""
        length = np.zeros(len(i), np.int64)
        i, j = i.copy(), j.copy()
        for t in range(len(self.levels) - 1, -1, -1):
            step = np.where(self.levels[t][i] == self.levels[t][j], 1 << t, 0)
            length += step
            i += step
            j += step
        return length


class _Nearest:
    """Nearest places to either side with a smaller value, by minima of doubled spans."""

    def __init__(self, values: np.ndarray, reach: int):
        self.tables = [values]
        while (1 << len(self.tables)) <= reach and len(values) >= 1 << len(self.tables):
            t, half = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(t[:-half], t[half:]))

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Last place before ``at`` with a value below ``least``; place 0 has value 0."""
        p = at.copy()
        for t in range(len(self.tables) - 1, -1, -1):
            q = p - (1 << t)
            p = np.where((q >= 0) & (self.tables[t][np.maximum(q, 0)] >= least), q, p)
        return p - 1

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """First place after ``at`` with a value below ``least``; the last place has value 0."""
        p = at + 1
        for t in range(len(self.tables) - 1, -1, -1):
            table = self.tables[t]
            inside = p < len(table)
            p = np.where(inside & (table[np.minimum(p, len(table) - 1)] >= least), p + (1 << t), p)
        return p


def branching_squares(sa: SuffixArray, fewest: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of squares that the next word does not continue, from intervals of ``fewest`` suffixes or more."""
    x = np.flatnonzero(sa.lcp > 0)
    none = np.zeros(0, np.int64)
    if not len(x):
        return none, none
    depth = sa.lcp[x]
    near = _Nearest(sa.lcp, sa.widest)
    low, high = near.left(x, depth), near.right(x, depth) - 1
    wide = high - low + 1 >= fewest
    x, depth, low, high = x[wide], depth[wide], low[wide], high[wide]
    if not len(x):
        return none, none
    before, after = near.left(x, depth + 1), near.right(x, depth + 1)
    last = sa.lcp[after] < depth  # the interval's last cut has a child on its right, too
    start = np.r_[before, x[last]]
    stop = np.r_[x - 1, after[last] - 1]
    depth, low, high = (np.r_[v, v[last]] for v in (depth, low, high))
    size = stop - start + 1
    order = np.lexsort((-size, high, low))
    largest = np.ones(len(order), bool)
    a, b = low[order], high[order]
    largest[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    small = order[~largest]
    size = size[small]
    child = np.repeat(small, size)
    r = np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size) + start[child]
    i, d = sa.order[r], depth[child]
    places, periods = [], []
    for partner, place in ((i + d, i), (i - d, i - d)):
        k = sa.inverse[np.clip(partner, 0, sa.size - 1)]
        found = (partner >= 0) & (k >= low[child]) & (k <= high[child]) & ((k < start[child]) | (k > stop[child]))
        places.append(place[found])
        periods.append(d[found])
    return np.concatenate(places), np.concatenate(periods)


def find(symbols: np.ndarray, first: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Runs of several sequences as rows (sequence, start, length, period), sorted."""
    if exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    sa = SuffixArray(symbols, first, exponent)
    i, d = branching_squares(sa, exponent)
    # rotate to the left: the stretch has to reach exponent periods back from the square's end
    s = i - (exponent - 2) * d
    i, d, s = (v[s >= 0] for v in (i, d, s))
    if exponent > 2:
        long = sa.common(s, s + d) >= i + d - s
        i, d, s = i[long], d[long], s[long]
    for t in range(int(sa.size).bit_length() - 1, -1, -1):
        q = s - (1 << t)
        some = np.flatnonzero(q >= 0)
        q = q[some]
        far = sa.common(q, q + d[some]) >= i[some] + d[some] - q
        s[some[far]] = q[far]
    length = i + 2 * d - s
    enough = length >= np.maximum(least, exponent * d)
    s, d, length = s[enough], d[enough], length[enough]
    order = np.lexsort((d, length, s))
    s, d, length = s[order], d[order], length[order]
    once = np.ones(len(s), bool)
    once[1:] = (s[1:] != s[:-1]) | (length[1:] != length[:-1])
    s, d, length = s[once], d[once], length[once]
    doc = np.searchsorted(sa.begin, s, "right") - 1
    rows = np.stack([doc, s - sa.begin[doc], length, d], axis=1) if len(s) else np.zeros((0, 4), np.int64)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when every run (start, length, period) keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


#: A rule that gives a text's words from its own: (id, number of words) -> places to read, or None to leave it.
Rewrite = Callable[[int | None, int], np.ndarray | None]


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The task's fixed rule: one document in ten repeats a short stretch up to its end. A null id changes nothing."""
    if doc_id is None or n == 0 or (h := py_id_crc(doc_id)) % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def _slices(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None) -> Iterator[tuple[list, Words, np.ndarray, np.ndarray]]:
    """ids, words, source place of each word, and runs of each slice of (id, text)."""
    for part in text_slices(batches, 1):
        words = Words(part.column(1), BYTE_POWERS)
        ids = part.column(0).to_pylist()
        source = np.arange(len(words.start))
        if rewrite:
            for k, doc_id in enumerate(ids):
                at, n = words.first[k], words.first[k + 1] - words.first[k]
                if (places := rewrite(doc_id, int(n))) is not None:
                    source[at : at + n] = at + places
        yield ids, words, source, find(word_numbers(words)[source], words.first)


def _text(words: Words, data: bytes, source: np.ndarray) -> bytes:
    return b" ".join([data[s:e] for s, e in zip(words.start[source].tolist(), words.end[source].tolist(), strict=True)])


def runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, start, length, period of every run of every row of (doc_id, text)."""
    schema = "doc_id long, start long, length long, period long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, found in _slices(batches, rewrite):
            columns = [pa.array(ids, pa.int64()).take(pa.array(found[:, 0])), *(pa.array(found[:, k]) for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "period"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _per_text(docs: DataFrame, schema: str, rewrite: Rewrite | None, row: Callable[[np.ndarray, int, bytes], tuple]) -> DataFrame:
    fields = arrow_fields(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, source, found in _slices(batches, rewrite):
            data = words.data.tobytes()
            edges = np.searchsorted(found[:, 0], np.arange(len(ids) + 1))
            out = []
            for k, doc_id in enumerate(ids):
                at, to = words.first[k], words.first[k + 1]
                mine = found[edges[k] : edges[k + 1], 1:]
                places = source[at:to][kept_words(int(to - at), mine)] if len(mine) else source[at:to]
                out.append((doc_id, *row(mine, int(to - at), _text(words, data, places))))
            yield arrow_batch(fields, out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def collapse(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, text with the first period of every run only, words joined by one space (null: empty)."""
    return _per_text(docs, "doc_id long, text string", rewrite, lambda found, n, text: (text.decode("utf-8", "replace"),))


def digests(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the longest run (ties: first, then smallest period; none:
    null), and digests of all runs and of the collapsed text."""

    def row(found: np.ndarray, n: int, text: bytes) -> tuple:
        lines = "".join([f"{s},{k},{p}\n" for s, k, p in found.tolist()])
        best: tuple = (None, None, None, None)
        if len(found):
            s, k, p = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
            best = (s, k, p, 1000 * k // p)
        return len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _per_text(docs, schema, rewrite, row)
