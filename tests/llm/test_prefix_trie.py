"""The prefix trie against one built turn by turn."""

import hashlib
import random
import zlib

import pytest

from cellframe.llm import prefix_trie
from cellframe.llm.queries import QUERIES


def sequences(rows):
    """conv_id -> [(role, text), ...] in order."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, v in convs.items()}


def shared(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[key]) - 1) * len(key[-1][1].encode().split()) if key else 0
        leaves[key] = sum(leaves[k] for k in children.get(key, [])) or 1
        saved[key] = own + sum(saved[k] for k in children.get(key, []))
    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(key))
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), len(children.get(key, [])), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-30, 120):
        if c % 7 == 3:
            continue
        n = rng.choice([1, 2, 3, 4, 9, 20])
        for t in range(n):
            turn = None if rng.random() < 0.1 else t
            rows.append((c, turn, rng.choice(["user", "assistant", None]) if t > 3 else "user", rng.choice(["a b", "c", None, "", " x\ty "]) if t > 1 else "hello there"))
    rows += [(200 + k, t, "user", f"same words {t}") for k in range(60) for t in range(12)]
    rows += [(300, t, "user", "again") for t in range(70)] + [(301, t, "user", "again") for t in range(75)]
    rows += [(None, 0, "user", "nobody's"), (400, 5, "user", "tie"), (400, 5, "assistant", "tie"), (400, 5, "a!", "tie"), (400, 5, "a", "tie")]
    rows += [(400, 5, "a", "tie"), (401, 0, "user", "long " * 50_000)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module", params=[1, 2])
def rows(request):
    return random_rows(request.param)


@pytest.mark.parametrize("size", [3, 32])
def test_trie(spark, rows, size, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RANGE_BLOCKS", 50)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as depth", "1 as words").repartition(5)
    turns = prefix_trie.numbered_turns(df)
    got = rows_of(prefix_trie.trie(prefix_trie.shared_heads(turns), size))
    assert got == brute(shared(sequences(rows)))
    if size == 3:
        assert rows_of(prefix_trie.trie(prefix_trie.rooted(turns), size)) == brute(sequences(rows))


def test_copies_over_every_border(spark, monkeypatch):
    """All conversations are one, so every range is cut through one node, at every depth."""
    monkeypatch.setattr(prefix_trie, "RANGE_BLOCKS", 10)
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 200) for t in range(5)]
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(prefix_trie.trie(prefix_trie.rooted(turns), 2)) == brute(sequences(rows))


def test_empty_table(spark):
    turns = prefix_trie.numbered_turns(spark.createDataFrame([], SCHEMA))
    assert prefix_trie.trie(prefix_trie.shared_heads(turns)).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op11_prefix_trie"](spark, sf)) == brute(shared(sequences(rows)))
