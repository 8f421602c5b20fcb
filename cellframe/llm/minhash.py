"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a weighted set: shingles of SHINGLE words, weighted by how often they occur. Each unit of weight of a
shingle is a cell on which darts arrive by a hashed Poisson process in rank; a dart hits one of COORDINATES. The darts
that land inside a document's weights with a rank below (darts wanted) / (total weight) are thrown, and the earliest dart
of each coordinate is the signature; where a coordinate stays empty the rank limit doubles. Two documents agree in a
coordinate with probability equal to their weighted Jaccard similarity, sum of minima over sum of maxima. The cost is
one hash a shingle plus the darts, whatever COORDINATES is.

Documents with equal words are one node. Nodes meet in bands of ROWS coordinates. No bucket is expanded into all pairs:
the most central node of a bucket (the one in the largest buckets) is its pivot, and the nodes that share a bucket with a
pivot are its family. First each pivot is compared with its family, then the members that the links so far leave outside
the pivot's class are compared with all of the family. So every pair that shares a bucket is linked, found in one class or
compared. A family is read in blocks of bounded size, and similarities are taken on whole texts, whose cells travel as
48-bit numbers; only signatures that are 4.5 deviations below THRESHOLD are passed over. Of a signature 8 bits a coordinate
travel: unequal darts may look equal, which costs a comparison, never a pair. Links of THRESHOLD or more join classes. With 20 bands of 4, a pair at
similarity 0.8 meets with probability 0.99997.

The class id is the smallest doc_id of the class. Texts with fewer words than a shingle are one shingle; null texts and
texts without words are classes of their own; rows with equal text, equal or null ids share a class; an empty table
gives an empty table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import BYTE_POWERS, WORD_POWERS, Words, mix, run_hashes, text_slices
from cellframe.spark import settle

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
COORDINATES = BANDS * ROWS
#: Darts wanted for a document: all coordinates are hit with high probability.
DARTS = COORDINATES * (math.log(COORDINATES) + 4)
#: Bytes of text that a task hashes at a time; its tables and arrays grow with it.
SLICE = 1 << 18
#: Share of equal coordinates below which a pair is not verified: 4.5 deviations below THRESHOLD.
LEAST_EQUAL = 0.6
#: Nodes of a family that stand in one block.
BLOCK = 1024
#: Most words of 64 row numbers that are sent to every task; the driver holds about 100 bytes of each, and some copies.
MAX_WORDS = 100_000
#: Most entries of the families of rows, about 150 bytes each on the driver, that are sent to every task.
MAX_PLACES = 100_000
#: Bytes of a cell in a bag.
CELL = 6
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a batch and the text of each, in order of texts."""
    sizes = np.diff(words.first)
    count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    doc = np.repeat(np.arange(len(sizes)), count)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = words.first[:-1][doc] + inside
    end = np.minimum(start + n, words.first[1:][doc])
    return run_hashes(words.hashes[0], start, end, WORD_POWERS[0]), doc


def cells(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One hash for each unit of weight: the k-th occurrence of a shingle in a text is its k-th cell."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    starts = np.flatnonzero(new)
    again = np.arange(len(h)) - np.repeat(starts, np.diff(np.r_[starts, len(h)]))
    out = np.empty_like(h)
    out[order] = mix(h + again.astype(np.uint64) * _GOLD)
    return out


def signatures(hashes: np.ndarray, doc: np.ndarray, n: int, weight: np.ndarray) -> np.ndarray:
    """n x COORDINATES earliest darts of cells ``hashes`` of texts ``doc`` (ascending); ``weight`` is each text's total."""
    out = np.zeros((n, COORDINATES), np.uint64)
    want, todo = DARTS, weight > 0
    while todo.any():
        use = todo[doc]
        h, d = hashes[use], doc[use]
        limit = (want / np.maximum(weight, 1))[d]
        rank = np.zeros(len(h))
        landed: list[tuple[np.ndarray, ...]] = []
        k = np.uint64(0)
        while len(h):
            k += np.uint64(1)
            dart = mix(h ^ mix(np.full(1, k) * _GOLD))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            near = rank < limit
            h, d, rank, limit, dart = h[near], d[near], rank[near], limit[near], dart[near]
            name = mix(dart + _GOLD)
            landed.append((d * COORDINATES + (name % np.uint64(COORDINATES)).astype(np.int64), rank, name))
        place, ranks, names = (np.concatenate(x) for x in zip(*landed, strict=True))
        order = np.lexsort((ranks, place))
        place, names = place[order], names[order]
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        place, names = place[first], names[first]
        hit = np.bincount(place // COORDINATES, minlength=n) == COORDINATES
        full = hit[place // COORDINATES]
        out.reshape(-1)[place[full]] = names[full]
        todo = todo & ~hit
        want *= 2
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys, total weight and a 128-bit hash of the words of each text."""
    for part in text_slices(batches, 1, SLICE):
        w = Words(part.column(1), BYTE_POWERS)
        n = part.num_rows
        hashes, doc = shingles(w)
        weight = np.bincount(doc, minlength=n)
        sig = signatures(cells(hashes, doc), doc, n, weight)
        bands = np.full((n, BANDS), np.uint64(0))
        for b in range(BANDS):
            key = np.full(n, b + 1, np.uint64) * _GOLD
            for c in range(b * ROWS, (b + 1) * ROWS):
                key = mix(key ^ sig[:, c]) + _GOLD
            bands[:, b] = key
        equal = [run_hashes(w.hashes[i], w.first[:-1], w.first[1:], WORD_POWERS[i]).view(np.int64) for i in (0, 1)]
        offsets = pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32))
        keys = pa.ListArray.from_arrays(offsets, pa.array(bands.ravel().view(np.int64)))
        columns = [part.column(0), pa.array(equal[0]), pa.array(equal[1]), pa.array(weight), keys]
        yield pa.RecordBatch.from_arrays(columns, names=["rid", "k1", "k2", "weight", "bands"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature (8 bits a coordinate) and sorted cells (CELL bytes each) of each text, beside its places."""
    for part in text_slices(batches, 1, SLICE):
        n = part.num_rows
        hashes, doc = shingles(Words(part.column(1), BYTE_POWERS))
        weight = np.bincount(doc, minlength=n)
        cell = cells(hashes, doc)
        # the lowest bits of a dart's name give its coordinate
        sig = (signatures(cell, doc, n, weight) >> np.uint64(40)).astype(np.uint8)
        cell = cell[np.lexsort((cell, doc))] >> np.uint64(64 - 8 * CELL)
        raw = cell.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CELL]
        first = np.r_[0, np.cumsum(weight)]
        bags = pa.array([raw[first[i] : first[i + 1]].tobytes() for i in range(n)], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x.tobytes() for x in sig], pa.binary()), bags], names=["rid", "places", "sig", "bag"])


def _cells(bag: bytes) -> np.ndarray:
    out = np.zeros((len(bag) // CELL, 8), np.uint8)
    out[:, :CELL] = np.frombuffer(bag, np.uint8).reshape(-1, CELL)
    return out.view("<u8").ravel()


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted bags of cells; 0 where their sizes keep it below THRESHOLD."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if len(small) < THRESHOLD * len(large) or not len(small):
        return 0.0  # below THRESHOLD whatever they share
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return both / (len(x) + len(y) - both)


def _join(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join that deals both sides by the key. A settled table of row numbers has a few bytes a row and would be sent to
    every task by its size in files; on the driver it takes about 100 bytes a row and several copies."""
    return left.join(right.hint("merge"), on, how)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, comp: the smallest node of each node's component. Each round every component takes the smallest label next
    to it, and labels are followed two steps; a round's table is written and the last one forgotten."""
    both = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = _join(both, label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = _join(label, near, "node").select("node", "comp", F.least("comp", "m").alias("low"))
        # the component's label itself moves to the lowest label that any member saw
        roots = step.groupBy(F.col("comp").alias("root")).agg(F.min("low").alias("to"))
        new = _join(step, roots, step["comp"] == roots["root"]).select("node", F.least("low", "to").alias("comp"), (F.col("comp") != F.least("low", "to")).alias("moved"))
        new = settle(new)
        moved = new.filter("moved").limit(1).count()
        label = new.drop("moved")
        if not moved:
            break
    return _join(nodes, label, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def _among(rows: DataFrame, ids: DataFrame, there: bool = True) -> DataFrame:
    """Rows whose rid is in ``ids`` (or is not). The row numbers are sent as words of 64 bits, at most one for 64 rows of
    the input, so ``rows`` is not moved; from MAX_WORDS words on both sides are dealt by rid."""
    words = settle(ids.groupBy(F.shiftright("rid", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(rid & 63))")).alias("bits")))
    if words.count() > MAX_WORDS:
        return _join(rows, ids.select("rid"), "rid", "left_semi" if there else "left_anti")
    marked = rows.join(F.broadcast(words), F.shiftright("rid", 6) == F.col("word"), "inner" if there else "left")
    return marked.filter(F.coalesce(F.expr("bit_get(bits, int(rid & 63))"), F.lit(0)) == int(there)).select(*rows.columns)


def _beside(wide: DataFrame, narrow: DataFrame) -> DataFrame:
    """Rows of ``wide`` whose rid is in ``narrow`` (a row a rid), with its columns; where ``narrow`` is small ``wide`` is
    not moved, else those of its rows that are wanted are."""
    narrow = settle(narrow)
    if (narrow.agg(F.sum(F.size("places"))).first()[0] or 0) <= MAX_PLACES:
        return wide.join(F.broadcast(narrow), "rid")
    return _join(_among(wide, narrow), narrow, "rid")


def _places(family: DataFrame) -> DataFrame:
    """rid and its families, at most one a band: (pivot, rid, blocks, asked) as one row a rid."""
    return family.groupBy("rid").agg(F.collect_list(F.struct("pivot", "blocks", "asked")).alias("places"))


def _links(bags: DataFrame) -> DataFrame:
    """Links (a, b) of bags (rid, comp, places, sig, bag): in each family between asked nodes and all nodes of other
    components, of each asked node one to a component and block."""
    each = bags.select("rid", "comp", "sig", "bag", F.inline("places"))
    held = each.select("pivot", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("block"), "rid", "comp", "sig", "bag")
    spread = each.filter("asked").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(*(F.col(c).alias(f"q_{c}") for c in ("pivot", "block", "rid", "comp", "sig", "bag")))

    def compare(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(q) and len(r):
            ids, comps = r["rid"].to_numpy(), r["comp"].to_numpy()
            signs = np.frombuffer(b"".join(r["sig"]), np.uint8).reshape(-1, COORDINATES)
            sets = [_cells(x) for x in r["bag"]]
            for rid, comp, sig, bag in zip(q["q_rid"], q["q_comp"], q["q_sig"], q["q_bag"], strict=True):
                near = np.flatnonzero((comps != comp) & ((signs == np.frombuffer(sig, np.uint8)).mean(1) >= LEAST_EQUAL))
                x, joined = _cells(bag), set()
                for k in near.tolist():
                    if comps[k] not in joined and similarity(x, sets[k]) >= THRESHOLD:
                        joined.add(comps[k])
                        out.append((min(rid, int(ids[k])), max(rid, int(ids[k]))))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    found = spread.groupBy("q_pivot", "q_block").cogroup(held.groupBy("pivot", "block")).applyInPandas(compare, "a long, b long")
    return settle(found.distinct())


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered rows (rid, doc_id, text, and all columns of docs in the struct ``row``) and (rid, comp): the smallest row
    number of each row's class."""
    whole = settle(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("rid")))
    rows = whole.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "row")
    signs = settle(rows.select("rid", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_sign, "rid long, k1 long, k2 long, weight long, bands array<long>"))
    worded = signs.filter("weight > 0")
    copies = settle(_join(worded.select("rid", "k1", "k2"), worded.groupBy("k1", "k2").agg(F.min("rid").alias("node")), ["k1", "k2"]).select("rid", "node"))
    nodes = settle(_among(worded.select("rid", "bands"), copies.filter("rid != node"), there=False))
    keys = nodes.select("rid", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = settle(_join(keys, shared, "key"))
    weight = settle(members.groupBy("rid").agg(F.sum("n").alias("weight")))
    heavy = _join(members.select("key", "rid"), weight, "rid")
    pivots = heavy.groupBy("key").agg(F.max_by("rid", F.struct("weight", -F.col("rid"))).alias("pivot"))
    family = _join(members.select("key", "rid"), pivots, "key").select("pivot", "rid").distinct()
    family = settle(family)
    # settled sides are dealt on their own, so that a large family can be split
    blocks = settle(family.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    family = settle(_join(family, blocks, "pivot"))
    texts = _beside(rows.select("rid", "text"), _places(family.withColumn("asked", F.col("pivot") == F.col("rid"))))
    schema = "rid long, places array<struct<pivot:long,blocks:int,asked:boolean>>, sig binary, bag binary"
    bags = settle(texts.select("rid", "text", "places").mapInArrow(_pack, schema))
    ids = nodes.select(F.col("rid").alias("node"))
    links = _links(bags.withColumn("comp", F.col("rid")))
    comp = settle(components(ids, links))
    of_node = comp.withColumnRenamed("node", "rid")
    placed = settle(_join(_join(family, of_node, "rid"), comp.select(F.col("node").alias("pivot"), F.col("comp").alias("centre")), "pivot"))
    outside = settle(placed.filter("comp != centre").select("pivot").distinct())
    split = settle(_join(placed, outside, "pivot", "left_semi"))
    if split.limit(1).count():
        asked = _places(split.withColumn("asked", F.col("comp") != F.col("centre")))
        more = _links(_beside(bags.select("rid", "sig", "bag"), _join(asked, of_node, "rid")))
        if more.limit(1).count():
            comp = settle(components(ids, links.unionByName(more)))
    of_rows = _join(copies, comp.select(F.col("node").alias("node"), "comp"), "node").select("rid", "comp")
    alone = signs.filter("weight = 0").select("rid", F.col("rid").alias("comp"))
    return rows, of_rows.unionByName(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_members, representative of every row of (doc_id, text)."""
    rows, of_rows = classes(docs.select("doc_id", "text"))
    named = settle(_join(of_rows, rows.select("rid", "doc_id"), "rid"))
    ids = named.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_members"), F.min(F.struct("doc_id", "rid")).alias("first"))
    out = _join(named, ids, "comp")
    return out.select("doc_id", "class_id", "n_members", (F.col("rid") == F.col("first.rid")).alias("representative"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their class: of each class the one with the smallest doc_id, with all columns."""
    rows, of_rows = classes(docs)
    named = settle(_join(of_rows, rows.select("rid", "doc_id"), "rid"))
    first = named.groupBy("comp").agg(F.min(F.struct("doc_id", "rid")).alias("first"))
    gone = settle(_join(named, first, "comp").filter(F.col("rid") != F.col("first.rid")).select("rid"))
    return _among(rows, gone, there=False).select("row.*")
