"""Prefix trie of conversations: union-find over the common prefixes of sorted neighbours.

Turns are numbered, each gets two 64-bit hashes mixed with its place, and a conversation is cut into blocks of BLOCK
turns; the block of turns from kB on carries the hash of all turns before it, so equal (k, hash) means one place in the
trie, below which the turns of the block say all. A block has BLOCK + 1 turns at most, however long the conversation.

Blocks are dealt by ranges of (k, hash, turns, conversation) and sorted. In a range, every two neighbours share an edge
of the length of their common prefix (LCP). Edges are taken in descending depth: joining two components makes their
common node, or adds a child to it where one of them ends there already; chains of nodes without branches stay one
record until rows are written. Nodes that go over a border of ranges are known by the LCP across the border, one number
a border. A range's forest is contracted to these nodes, at most BLOCK + 2 a border, and they are merged by their hash;
everything else is final inside its range. A child counts where its node begins, a leaf where it ends, so that sums over
ranges count each once.

What lies below a block is added through conversations: each node's saving and each leaf belongs to its smallest member,
and running sums over later blocks give every block what its conversation owns further down.

Rows without a conversation id belong to none. Null role or text counts as empty; rows of one turn are ordered by role,
then text; null turns come first; repeated rows are turns of their own. Very long texts are hashed where they are read
and dealt by their first 64 characters. An empty table has no node, not even a root. Other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm.running import running
from cellframe.spark import lookup_join, settle

#: Turns of a block, and mean number of blocks of a range.
BLOCK = 32
RANGE_BLOCKS = 20_000

EMPTY = hashlib.sha256(b"").hexdigest()
_WORD = r"[^\x20\x09-\x0D]+"


# ---- turns ----


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, i (from 1), a, b (hashes), words of every turn of (conv_id, turn, role, text)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    rows = rows.select(
        "*",
        F.left("role", F.lit(64)).alias("_role"),
        F.left("text", F.lit(64)).alias("_text"),
        F.xxhash64("role", "text").alias("a"),
        F.xxhash64("text", F.lit("\0"), "role").alias("b"),
        F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"),
        F.lit(1).cast("long").alias("one"),
    )
    keep = ["conv_id", "a", "b", "words"]
    return running(rows, ["conv_id"], ["turn", "role", "text"], {"i": ("one", "sum")}, ["turn", "_role", "_text"], keep)


def shared_heads(turns: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """The task's fixed rule over numbered turns: the first h = crc32(conv_id) % most turns are those of the group's first
    conversation. conv_id, d, a, b, words with a row d = 0 for every conversation; an absent first one gives no turns."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    first = F.col("conv_id") % group == 0
    heads = turns.filter(first & (F.col("i") < most)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("i", "a", "b", "words"))).alias("head"))  # most - 1 turns at most
    convs = turns.filter("i = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
    convs = settle(convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int"))))
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("d"), zero.alias("a"), zero.alias("b"), zero.alias("words"))
    copied = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.i", "t.a", "t.b", "t.words")
    lack = convs.withColumn("lack", F.col("h") - F.size("head")).filter("lack > 0").select("conv_id", "lack")
    own = turns.filter(F.col("i") > h).join(lack, "conv_id", "left")
    own = own.select("conv_id", F.col("i") - F.coalesce("lack", F.lit(0)), "a", "b", "words")
    return root.union(copied).union(own)


def rooted(turns: DataFrame) -> DataFrame:
    """Numbered turns as they are, with a row d = 0 for every conversation."""
    zero = F.lit(0).cast("long")
    root = turns.filter("i = 1").select("conv_id", zero.alias("d"), zero.alias("a"), zero.alias("b"), zero.alias("words"))
    return root.union(turns.select("conv_id", "i", "a", "b", "words"))


def _blocks(turns: DataFrame, size: int) -> DataFrame:
    """conv_id, k, turns, g1, g2 (hash of all turns before), f1, f2 (of the whole conversation, where it ends).

    Block k holds the turns at depths kB to (k + 1)B, the last only to tell children apart. A conversation that ends at
    depth kB - 1 has an empty block k: its end is the parent of what others have there."""
    d = F.col("d")
    k = F.floor(d / size).cast("long")
    mixed = turns.select("conv_id", "d", F.xxhash64(F.lit(1), "d", "a", "b").alias("m1"), F.xxhash64(F.lit(2), "d", "b", "a").alias("m2"), "words")
    places = F.array(
        F.struct(k.alias("k"), F.lit(0).alias("as")),
        F.when((d % size == 0) & (d > 0), F.struct((k - 1).alias("k"), F.lit(1).alias("as"))),
        F.when(d % size == size - 1, F.struct((k + 1).alias("k"), F.lit(2).alias("as"))),
    )
    rows = mixed.withColumn("p", F.explode(F.array_compact(places))).select("*", "p.k", "p.as")
    own = F.col("as") == 0
    blocks = rows.groupBy("conv_id", "k").agg(
        F.array_sort(F.collect_list(F.when(F.col("as") < 2, F.struct("d", "m1", "m2", "words")))).alias("turns"),
        F.coalesce(F.bit_xor(F.when(own, F.col("m1"))), F.lit(0)).alias("x1"),
        F.coalesce(F.bit_xor(F.when(own, F.col("m2"))), F.lit(0)).alias("x2"),
        (F.max(own) & ~F.max(F.col("as") == 1)).alias("ends"),
    )
    turns_of = F.transform("turns", lambda t: F.struct(t["m1"].alias("m1"), t["m2"].alias("m2"), t["words"].alias("words")))
    blocks = settle(blocks.withColumn("turns", turns_of))
    summed = running(blocks, ["conv_id"], ["k"], {"p1": ("x1", "xor"), "p2": ("x2", "xor")})
    before = [F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"g{i}") for i in (1, 2)]
    whole = [F.when(F.col("ends"), F.col(f"p{i}")).alias(f"f{i}") for i in (1, 2)]
    return summed.select("conv_id", "k", "turns", *before, *whole)


# ---- one range ----


class _Forest:
    """Records of the trie of sorted blocks: a node and the chain of nodes without branches above it.

    ``hi`` is the node's depth in the block (0: the node that all of the group hang on) and ``lo`` the chain's top;
    ``start:stop`` are its rows, ``kids`` the children that begin here, ``ends`` its rows that end at the node. A node
    goes over the range's left border if its rows begin with the first and the border's LCP reaches its depth."""

    FIELDS = "hi lo n least kids any leaves saved start stop ends parent".split()

    def __init__(self, size, length, lcp, conv, below_saved, below_leaves, sums, left, right):
        self.size, self.left, self.right, self.rows, self.sums = size, left, right, len(length), sums
        n = len(length)
        hi, conv = length.tolist(), conv.tolist()
        self.r = r = {f: [0] * n for f in self.FIELDS}
        r["hi"], r["lo"], r["n"], r["least"], r["any"] = hi, [0] * n, [1] * n, conv, [False] * n
        r["leaves"], r["saved"] = below_leaves.tolist(), below_saved.tolist()
        r["start"], r["stop"], r["ends"], r["parent"] = list(range(n)), list(range(1, n + 1)), [1] * n, [-1] * n
        self.same = {}  # records of one node that were joined
        up = list(range(n))  # union-find over rows
        top = list(range(n))  # record of each component

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        edges = np.flatnonzero(lcp >= 0) + 1
        order = edges[np.argsort(-lcp[edges - 1], kind="stable")]
        for i, depth in zip(order.tolist(), lcp[order - 1].tolist(), strict=True):
            x, y = find(i - 1), find(i)
            up[y] = x
            top[x] = self._join(top[x], top[y], depth)
        for x in range(n):
            if up[x] == x and hi[top[x]] > 0:
                self._join(top[x], None, 0)

    def _join(self, a: int, b: int | None, depth: int) -> int:
        hi = self.r["hi"]
        if hi[a] > depth:
            if b is not None and hi[b] == depth:
                self._hang(a, b)
                return b
            node = self._new(a, depth)
            self._hang(a, node)
            a = node
        if b is not None:
            if hi[b] > depth:
                self._hang(b, a)
            else:
                self._same(a, b)
        return a

    def _new(self, below: int, depth: int) -> int:
        r = self.r
        values = {"hi": depth, "least": r["least"][below], "any": False, "start": r["start"][below], "stop": r["stop"][below], "parent": -1}
        for f in self.FIELDS:
            r[f].append(values.get(f, 0))
        return len(r["hi"]) - 1

    def _cover(self, a: int, b: int) -> None:
        r = self.r
        r["n"][a] += r["n"][b]
        r["least"][a] = min(r["least"][a], r["least"][b])
        r["start"][a] = min(r["start"][a], r["start"][b])
        r["stop"][a] = max(r["stop"][a], r["stop"][b])

    def _same(self, a: int, b: int) -> None:
        """Two records of one node become one."""
        r = self.r
        for f in ("kids", "leaves", "saved", "ends"):
            r[f][a] += r[f][b]
        r["any"][a] = r["any"][a] or r["any"][b]
        self._cover(a, b)
        self.same[b] = a

    def _hang(self, c: int, node: int) -> None:
        """Close record c as a child of ``node``."""
        r = self.r
        depth, hi, start = r["hi"][node], r["hi"][c], r["start"][c]
        r["lo"][c], r["parent"][c] = depth + 1, node
        inside = not (r["stop"][c] == self.rows and self.right >= hi)
        if not r["any"][c] and hi <= self.size and inside:
            r["leaves"][c] += 1
        words = self.sums[start]
        from_here = max(depth, min(hi, self.left)) if start == 0 else depth
        r["leaves"][node] += r["leaves"][c]
        r["saved"][node] += r["saved"][c] + int(r["n"][c] * (words[hi] - words[depth]) - (words[hi] - words[from_here]))
        r["kids"][node] += not (start == 0 and self.left > depth)
        r["any"][node] = True
        self._cover(node, c)

    def records(self) -> dict[str, np.ndarray]:
        alive = np.ones(len(self.r["hi"]), bool)
        alive[list(self.same)] = False

        def real(x):
            while x in self.same:
                x = self.same[x]
            return x

        number = np.cumsum(alive) - 1
        parent = np.array([real(p) for p in self.r["parent"]], np.int64)
        out = {f: np.array(self.r[f], np.int64)[alive] for f in self.FIELDS}
        out["parent"] = np.where(parent >= 0, number[parent], -1)[alive]
        return out


_NODES = (
    "conv_id long, depth long, k long, id1 long, id2 long, up1 long, up2 long, parent_conv_id long, pending boolean, border boolean, "
    "owned boolean, words long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_ends long, ends_sha256 string"
)


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def _range_nodes(size: int, k, g1, g2, length, m1, m2, words, conv, saved, leaves, left: int, right: int) -> Iterator[pa.RecordBatch]:
    """Nodes of the blocks of one range, a few thousand records at a time."""
    n, width = len(k), size + 2
    at = np.arange(width - 1)
    there = at[None, :] < length[:, None]
    table = {}
    for name, values, head in (("m1", m1, g1), ("m2", m2, g2), ("w", words, np.zeros(n, np.int64))):
        full = np.zeros((n, width), np.int64)
        full[:, 0] = head
        full[:, 1:][there] = values
        table[name] = full
    same = (k[1:] == k[:-1]) & (g1[1:] == g1[:-1]) & (g2[1:] == g2[:-1])
    equal = there[1:] & there[:-1]
    for name in ("m1", "m2"):
        equal &= table[name][1:, 1:] == table[name][:-1, 1:]
    lcp = np.where(same, np.logical_and.accumulate(equal, axis=1).sum(axis=1), -1)
    table["w"][:, size + 1] = 0  # the last place belongs to the next block
    sums = np.cumsum(table["w"], axis=1)
    prefix = [np.bitwise_xor.accumulate(table[name], axis=1) for name in ("m1", "m2")]
    forest = _Forest(size, length, lcp, conv, saved, leaves, sums, left, right)
    every = forest.records()
    base = k * size - 1

    def over(start, stop, depth):
        return ((start == 0) & (left >= depth)) | ((stop == n) & (right >= depth))

    for begin in range(0, len(every["hi"]), 4096):
        r = {f: v[begin : begin + 4096] for f, v in every.items()}
        whole = r["hi"] == 0  # the group's node: written only where other ranges hang on it
        low = np.where(whole, 0, np.maximum(r["lo"], 1))
        high = np.minimum(r["hi"], size)
        group = k[r["start"]]
        count = np.where(whole, over(r["start"], r["stop"], 0) & (group > 0), np.maximum(high - low + 1, 0))
        of = np.repeat(np.arange(len(low)), count)
        if not len(of):
            continue
        j = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of]
        v = {f: x[of] for f, x in r.items()}
        row = v["start"]
        end = j == v["hi"]
        parent = np.maximum(v["parent"], 0)
        top = (j == v["lo"]) & (j > 0)
        up_start, up_stop = np.where(top, every["start"][parent], v["start"]), np.where(top, every["stop"][parent], v["stop"])
        up_least = np.where(top, every["least"][parent], v["least"])
        border = over(v["start"], v["stop"], j)
        root = (group[of] == 0) & (j == 1)
        pending = (j > 0) & ~root & over(up_start, up_stop, j - 1)
        before = np.maximum(j - 1, 0)
        last = sums[row, v["hi"]]
        from_here = np.where(row == 0, np.maximum(before, np.minimum(v["hi"], left)), before)
        total = v["saved"] + v["n"] * (last - sums[row, before]) - (last - sums[row, from_here])
        children = np.where(end, v["kids"], 1 - ((row == 0) & (left > j)))
        n_ends = np.where(end & (j > 0), v["ends"], 0)
        digests = np.full(len(of), EMPTY, object)
        digests[border] = None
        for x in np.flatnonzero((n_ends > 0) & ~border):
            digests[x] = _digest(conv[row[x] : row[x] + n_ends[x]])
        columns = {
            "conv_id": v["least"], "depth": base[row] + j, "k": group[of], "id1": prefix[0][row, j], "id2": prefix[1][row, j],
            "up1": prefix[0][row, before], "up2": prefix[1][row, before],
            "parent_conv_id": pa.array(up_least, mask=root | pending | (j == 0)), "pending": pending, "border": border, "owned": j > 0,
            "words": table["w"][row, j] * (j > 0), "n_convs": v["n"], "n_children": children, "n_leaves": v["leaves"], "saved_tokens": total,
            "n_ends": n_ends, "ends_sha256": pa.array(digests.tolist(), pa.string()),
        }
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _forests(size: int):
    """Sorted blocks of a task, range after range, into nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close():
            if not held:
                return
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            k, g1, g2, conv, saved, leaves, left, right, length, m1, m2, words = columns
            yield from _range_nodes(size, k, g1, g2, length, m1, m2, words, conv, saved, leaves, int(left[0]), int(right[0]))

        for batch in batches:
            ranges = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(ranges[1:] != ranges[:-1]) + 1, batch.num_rows]
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if s == e:
                    continue
                if ranges[s] != now:
                    yield from close()
                    now, held = ranges[s], []
                part = batch.slice(s, e - s)
                turns = part.column(part.schema.get_field_index("turns"))
                length = pc.list_value_length(turns).to_numpy().astype(np.int64)
                flat = turns.flatten()
                numbers = [c.to_numpy() for c in part.columns[2:]]
                held.append([*numbers, length, *(flat.field(i).to_numpy() for i in range(3))])
        yield from close()

    return run


def _common(a: F.Column, b: F.Column) -> F.Column:
    """LCP of the turns of two blocks, -1 if they hang on different nodes."""
    equal = F.zip_with(a["turns"], b["turns"], lambda x, y: F.coalesce(x == y, F.lit(False)))
    differ = F.array_position(equal, F.lit(False))
    shared = F.when(differ == 0, F.size(equal)).otherwise(differ - 1)
    same = (a["k"] == b["k"]) & (a["g1"] == b["g1"]) & (a["g2"] == b["g2"])
    return F.when(same, shared).otherwise(-1).cast("long")


def _nodes(blocks: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Final nodes of their ranges, and merged nodes that go over borders."""
    key = ["k", "g1", "g2", "turns", "conv_id"]
    blocks = settle(blocks)
    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks.count() // RANGE_BLOCKS))
    dealt = settle(blocks.repartitionByRange(parts, *key).withColumn("range", F.spark_partition_id().cast("long")))
    ends = dealt.groupBy("range").agg(F.min(F.struct(*key[:4])).alias("first"), F.max(F.struct(*key[:4])).alias("last"))
    by = Window.orderBy("range")  # one row a range
    borders = ends.select("range", _common(F.lag("last").over(by), F.col("first")).alias("left"), _common(F.col("last"), F.lead("first").over(by)).alias("right"))
    borders = F.broadcast(settle(borders, small=True))
    ordered = dealt.join(borders, "range").repartition(parts, "range").sortWithinPartitions("range", *key)
    ordered = ordered.select("range", "turns", "k", "g1", "g2", "conv_id", "saved", "leaves", "left", "right")
    nodes = settle(ordered.mapInArrow(_forests(size), _NODES))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends")]
    same = [F.first(c).alias(c) for c in ("up1", "up2", "pending", "owned", "words")]
    merged = nodes.filter("border").groupBy("k", "depth", "id1", "id2").agg(F.min("conv_id").alias("conv_id"), *same, *sums)
    return nodes.filter("not border"), settle(merged)


# ---- the whole trie ----


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (f1, f2, conv_id) of a task as joined ids, one node's in pieces of 8,192."""
    for batch in batches:
        f1, f2, conv, part = (c.to_numpy() for c in batch.columns)
        cuts = np.r_[0, np.flatnonzero((f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])) + 1, len(f1)]
        spans = [(s, min(s + 8192, e)) for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for s in range(a, e, 8192)]
        text = [",".join(map(str, conv[s:e].tolist())) for s, e in spans]
        first = [s for s, _ in spans]
        yield pa.RecordBatch.from_arrays([pa.array(f1[first]), pa.array(f2[first]), pa.array(conv[first]), pa.array(text)], names=["id1", "id2", "at", "text"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of pieces in order; a task holds one batch and one digest."""
    now, digest, names = None, None, ["id1", "id2", "ends"]

    def done(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.int64()), pa.array([r[0][1] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=names)

    for batch in batches:
        rows = []
        for id1, id2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (id1, id2) != now:
                if digest:
                    rows.append((now, digest.hexdigest()))
                now, digest = (id1, id2), hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if rows:
            yield done(rows)
    if digest:
        yield done([(now, digest.hexdigest())])


def _end_digests(blocks: DataFrame, merged: DataFrame) -> DataFrame:
    """id1, id2, ends: digests of the ids that end at nodes over borders, whatever their number."""
    asked = merged.filter("n_ends > 0").select(F.col("id1").alias("f1"), F.col("id2").alias("f2"))
    rows = lookup_join(blocks.filter("f1 is not null").select("f1", "f2", "conv_id"), asked, ["f1", "f2"])
    rows = settle(rows.select("f1", "f2", "conv_id"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // 1_000_000))
    ranged = rows.repartitionByRange(parts, "f1", "f2", "conv_id").sortWithinPartitions("f1", "f2", "conv_id").withColumn("part", F.spark_partition_id())
    pieces = ranged.mapInArrow(_pieces, "id1 long, id2 long, at long, text string")
    return pieces.repartition(parts, "id1", "id2").sortWithinPartitions("id1", "id2", "at").select("id1", "id2", "text").mapInArrow(_ends, "id1 long, id2 long, ends string")


def trie(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """Every node of the prefix trie of (conv_id, d, a, b, words), turns d = 1, 2, ... and a row d = 0 a conversation:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    blocks = settle(_blocks(turns, size).withColumns({"saved": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long")}))
    deep = blocks.filter("k > 0")
    if not deep.isEmpty():
        # what each conversation owns in its later blocks
        parts = [n.filter("owned").select("conv_id", "k", "n_convs", "words", "n_children") for n in _nodes(deep, size)]
        owned = parts[0].union(parts[1]).groupBy("conv_id", "k")
        owned = owned.agg(F.sum((F.col("n_convs") - 1) * F.col("words")).alias("s"), F.sum((F.col("n_children") == 0).cast("long")).alias("l"))
        owned = owned.filter("s > 0 or l > 0")
        rows = blocks.drop("saved", "leaves").join(owned, ["conv_id", "k"], "left").fillna(0, ["s", "l"]).withColumn("back", -F.col("k"))
        summed = running(settle(rows), ["conv_id"], ["back"], {"ts": ("s", "sum"), "tl": ("l", "sum")})
        blocks = settle(summed.withColumns({"saved": F.col("ts") - F.col("s"), "leaves": F.col("tl") - F.col("l")}).drop("back", "s", "l", "ts", "tl"))
    inside, merged = _nodes(blocks, size)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parents = merged.select("k", F.col("depth").alias("above"), F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    ends = _end_digests(blocks, merged)
    over = merged.filter("owned").join(ends, ["id1", "id2"], "left").withColumn("ends_sha256", F.coalesce(F.when(F.col("n_ends") > 0, F.col("ends")), F.lit(EMPTY)))
    hung = inside.filter("pending").drop("parent_conv_id").unionByName(over, allowMissingColumns=True).withColumn("above", F.col("depth") - 1)
    hung = lookup_join(hung, parents, ["k", "above", "up1", "up2"], "left", settled=True)
    return inside.filter("not pending").select(*out).unionByName(hung.select(*out))
