"""Packing of documents into token sequences: shortest pack first over the histogram of lengths.

Whole windows are cut off each document first; what remains has a length below the window, and only the histogram of
these lengths, with at most a window of rows, reaches the driver. There, lengths are placed longest first, each into the
packs with the fewest tokens so far. Packs of one filling are one group of consecutive sequence numbers with a count, so
a step places as many documents of a length as a group has packs, whatever their number. As documents may be cut, there
are exactly as many packs as the tokens fill: full ones, and for the tokens over one of each power of two in their sum.
A length that fits nowhere fills the emptiest packs; what it leaves over is a shorter length, placed in its turn. So every
pack ends up full to its size, at most one document a pack is cut, and padding is none.

The steps say: documents of this length with these ranks go to these packs at this place. Documents find them by rank
inside their length, which is counted over sorted ranges, so a length that a third of all documents share spans tasks.
The number of steps grows with the window and the groups of packs (a window at most, and a few for cuts), not with rows.

Token ids come from the tokenizers library. Texts are cut at ASCII white space, where its normalizer and splitter never
look across, and every distinct piece of a slice goes through the library once; equal pieces share the result.

Null and empty texts have only the closing id. Repeated rows are packed as often as they stand, ties of rank in any order
fixed by one writing; null ids come first; an empty table gives no pieces; other columns are not read. Whole texts are
encoded, a slice of about a megabyte (or one longer text) at a time."""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.bpe import byte_letters
from cellframe.llm.common import kept, text_slices
from cellframe.llm.running import running
from cellframe.spark import settle

WINDOW = 4096
#: Bytes of remembered pieces of text in each task; the store is emptied when full, which changes no result.
CACHE_BYTES = 96 << 20
_RANKS = 1 << 45


#: Fixed value: the split by which a definition takes a run of letters, and a run of marks after it, as one word each.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin letters that normalization only lower-cases, then marks: most pieces of text.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)").fullmatch


class PieceEncoder:
    """Ids of whole texts by a tokenizers definition, as bytes, piece by piece between ASCII white space.

    Pieces that are not known yet go through the library side by side, with an added token between them. Where the
    definition lower-cases and splits by WORD_SPLIT, Latin letters with marks behind go straight to the library's model
    as the two words that they are."""

    BORDER = "\0|\0"

    def __init__(self, definition: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.plain, self.joined = Tokenizer.from_str(definition), Tokenizer.from_str(definition)
        for t in (self.plain, self.joined):
            t.no_truncation()
            t.no_padding()
        self.joined.add_special_tokens([self.BORDER])
        self.border = self.joined.token_to_id(self.BORDER)
        self.dtype, self.known, self.words, self.held = np.dtype(dtype), {}, {"": b""}, 0
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        spec = json.loads(definition)
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        byte_level = len(split) == 2 and split[1].get("type") == "ByteLevel" and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
        self.simple = steps == ["NFC", "Replace", "Lowercase"] and byte_level and split[0].get("pattern") == {"Regex": WORD_SPLIT}
        self.model, self.letters = self.plain.model, dict(enumerate(byte_letters()))

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = self.words[word] = array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()
        self.held += len(word) + len(ids) + 180
        return ids

    def _learn(self, pieces: list[bytes]) -> None:
        rest, known, words = [], self.known, self.words
        for piece in pieces:
            if self.simple and (m := _SIMPLE(piece.decode())):
                word, marks = m[1].lower(), m[2]
                ids = words.get(word) or self._word(word)
                if marks:
                    ids += words.get(marks) or self._word(marks)
                known[piece] = ids
                self.held += len(piece) + len(ids) + 180
            else:
                rest.append(piece)
        for at in range(0, len(rest), 1024):
            self._learn_joined(rest[at : at + 1024])

    def _learn_joined(self, some: list[bytes]) -> None:
        texts = [p.decode() for p in some]
        if any(self.BORDER in t for t in texts):
            ids = [np.array(self.plain.encode(t, add_special_tokens=False).ids, self.dtype).tobytes() for t in texts]
        else:
            every = np.array(self.joined.encode_batch_fast([self.BORDER.join(texts)], add_special_tokens=False)[0].ids, np.int64)
            size = self.dtype.itemsize
            cuts = (np.flatnonzero(every == self.border) * size).tolist()
            raw = every.astype(self.dtype).tobytes()
            ids = [raw[s:e] for s, e in zip([0, *[c + size for c in cuts]], [*cuts, len(raw)], strict=True)]
        self.known.update(zip(some, ids, strict=True))
        self.held += sum(map(len, some)) + sum(map(len, ids)) + 180 * len(some)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").encode().split() for t in texts]
        if self.held > CACHE_BYTES:
            self.known, self.words, self.held = {}, {"": b""}, 0
        self._learn(list(set().union(*split).difference(self.known)))
        find = self.known.__getitem__
        return [b"".join(map(find, pieces)) for pieces in split]


def loaded(definition: str, dtype: str) -> PieceEncoder:
    """The encoder of a definition, built once in each Python worker."""
    return kept(("pieces", len(definition), hash(definition), dtype), lambda: PieceEncoder(definition, dtype))


def _ids_type(definition: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_str(definition).get_vocab_size(True) <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str, closing: int) -> tuple[DataFrame, str]:
    """doc_id, n (tokens, the closing id included), ids (binary) of every row of (doc_id, text); and the type of an id."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    dtype = _ids_type(definition)
    spec = docs.sparkSession.sparkContext.broadcast(definition)  # one vocabulary file
    last = np.array([closing], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(spec.value, dtype)
        for part in text_slices(batches, 1):
            ids = [b + last for b in encoder.encode(part.column(1).to_pylist())]
            n = [len(b) // len(last) for b in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, ids binary"), dtype


@dataclass
class Plan:
    """Steps of a packing, sorted by length and first rank. Items of ``length`` with ranks from ``rank`` on (up to the
    next step's) lie ``piece`` tokens long at ``offset`` of the sequences from ``sequence`` on; where the piece is
    shorter, the rest has the length that is left and ranks from ``then`` on."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    piece: np.ndarray
    then: np.ndarray
    sizes: list[tuple[int, int]]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The step of each item, and its number inside the step."""
        step = np.searchsorted(self.length * _RANKS + self.rank, length * _RANKS + rank, "right") - 1
        return step, rank - self.rank[step]


def plan(histogram: Iterable[tuple[int, int]], window: int = WINDOW) -> Plan:
    """Shortest pack first for (length, count) with lengths up to the window."""
    count = np.zeros(window + 1, np.int64).tolist()
    for length, n in histogram:
        count[length] += n
    total = sum(k * n for k, n in enumerate(count))
    sizes = [(window, total // window)] if total >= window else []
    sizes += [(1 << b, 1) for b in range(window.bit_length(), -1, -1) if (total % window) >> b & 1]
    groups, at = [], 0
    for size, n in sizes:
        groups.append((-size, at, n, size))
        at += n
    heapq.heapify(groups)  # most room first, then the smallest sequence number
    steps = []
    for length in range(window, 0, -1):
        rank, left = 0, count[length]
        while left:
            room, first, packs, size = heapq.heappop(groups)
            room = -room
            n, piece = min(left, packs), min(length, room)
            then = -1
            if piece < length:
                then = count[length - piece]
                count[length - piece] += n
            steps.append((length, rank, first, size - room, piece, then))
            if packs > n:
                heapq.heappush(groups, (-room, first + n, packs - n, size))
            if room > piece:
                heapq.heappush(groups, (piece - room, first, n, size))
            rank, left = rank + n, left - n
    steps.sort()
    columns = np.array(steps, np.int64).reshape(-1, 6).T
    return Plan(*columns, sizes)


def place(p: Plan, window: int, n: np.ndarray, rank: np.ndarray, fulls: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces (row, start, length, sequence, offset) of rows with n tokens. ``rank`` counts rows of equal remainder, and
    ``fulls`` whole windows of all earlier rows; both from 0."""
    whole, rest = n // window, n % window
    row = np.repeat(np.arange(len(n)), whole)
    k = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
    out = []
    rows = np.r_[row, np.flatnonzero(rest)]
    start = np.r_[k * window, (whole * window)[rest > 0]]
    length = np.r_[np.full(len(row), window), rest[rest > 0]]
    ranks = np.r_[fulls[row] + k, rank[rest > 0]]
    while len(rows):
        step, inside = p.find(length, ranks)
        piece = p.piece[step]
        out.append((rows, start, piece, p.sequence[step] + inside, p.offset[step]))
        cut = piece < length
        rows, start, length, ranks = rows[cut], (start + piece)[cut], (length - piece)[cut], (p.then[step] + inside)[cut]
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    order = np.lexsort((columns[1], columns[0]))
    return tuple(c[order] for c in columns)


def pack(rows: DataFrame, dtype: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit) of every piece of rows
    (doc_id, n, ids)."""
    spark = rows.sparkSession
    rows = settle(rows)
    sized = rows.select("*", (F.col("n") % window).alias("rest"), F.floor(F.col("n") / window).alias("whole"), F.lit(1).cast("long").alias("one"))
    ranked = running(sized, ["rest"], ["doc_id"], {"rank": ("one", "sum"), "fulls": ("whole", "sum")})
    lengths = ranked.groupBy("rest").agg(F.count("*").alias("k"), F.sum("whole").alias("w")).orderBy("rest").collect()  # a window of rows at most
    steps = plan([(r.rest, r.k) for r in lengths if r.rest] + [(window, sum(r.w for r in lengths))], window)
    before = np.zeros(window, np.int64)
    before[[r.rest for r in lengths]] = np.cumsum([0, *(r.w for r in lengths)])[:-1]
    shared = spark.sparkContext.broadcast((steps, before))
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, before = shared.value
        for part in text_slices(batches, 5):
            doc_id, *numbers, ids = part.columns
            n, rank, fulls, whole = (c.to_numpy() for c in numbers)
            row, start, length, sequence, offset = place(steps, window, n, rank - 1, before[n % window] + fulls - whole)
            texts = [np.frombuffer(b, dtype).astype("<u4") for b in ids.to_pylist()]
            pieces = [texts[r][s : s + k].tobytes() for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            columns = [doc_id.take(pa.array(row)), *(pa.array(c) for c in (start, length, n[row], sequence, offset)), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return ranked.select("doc_id", "n", "rank", "fulls", "whole", "ids").mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (binary) of every sequence; its pieces have a window of tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(parts, F.unhex(F.lit("")), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
