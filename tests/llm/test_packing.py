"""Packing and running totals against plain Python."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellframe.llm import packing
from cellframe.llm.queries import QUERIES, VOCABULARY
from cellframe.llm.running import running


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([8, 16, 64]), st.lists(st.integers(1, 200), max_size=60))
def test_every_token_has_one_place_and_every_pack_is_full(window, lengths):
    n = np.array(sorted(lengths, key=lambda k: k % window), np.int64)
    rest, whole = n % window, n // window
    rank = np.array([int((rest[:k] == rest[k]).sum()) for k in range(len(n))], np.int64)
    p = packing.plan([(int(k), 1) for k in rest if k] + [(window, int(whole.sum()))], window)
    pieces = list(zip(*packing.place(p, window, n, rank, np.cumsum(whole) - whole), strict=True))
    per_row, per_pack = {}, {}
    for row, start, length, sequence, offset in pieces:
        per_row.setdefault(row, []).append((start, length))
        per_pack.setdefault(sequence, []).append((offset, length))
    ends = []
    for groups in (per_row, per_pack):
        for spans in groups.values():
            spans.sort()
            assert [s for s, _ in spans] == [0, *np.cumsum([k for _, k in spans])[:-1]]
        ends.append({g: sum(k for _, k in spans) for g, spans in groups.items()})
    assert ends[0] == {k: v for k, v in enumerate(n)}
    total = int(n.sum())
    assert sorted(ends[1].values(), reverse=True) == [window] * (total // window) + [1 << b for b in range(12, -1, -1) if (total % window) >> b & 1]
    assert sorted(ends[1]) == list(range(len(ends[1])))
    assert len(pieces) <= len(n) + int(whole.sum()) + len(ends[1])


def test_longest_lengths_come_first_and_go_to_the_shortest_pack():
    p = packing.plan([(5, 2), (3, 2), (6, 1), (2, 3), (4, 1)], 16)  # 32 tokens, two packs
    at = {(int(a), int(b)): (int(s), int(o)) for a, b, s, o in zip(p.length, p.rank, p.sequence, p.offset, strict=True)}
    assert at[6, 0] == (0, 0) and at[5, 0] == (1, 0) and at[5, 1] == (1, 5) and at[4, 0] == (0, 6)


def test_a_hot_length_takes_few_steps():
    p = packing.plan([(1, 10**9), (700, 10**8), (2100, 10**8)], 4096)
    assert len(p.length) < 10_000 and sum(k * n for k, n in p.sizes) == 10**9 + 2800 * 10**8


TEXTS = [
    (0, None),
    (1, ""),
    (2, " \n\t "),
    (3, "one two"),
    (3, "one two"),
    (None, "no id"),
    (4, " ".join(f"word{k}" for k in range(9000))),
    (5, "İstanbul ſ ǅ \x1c a b <|endoftext|> it's é ́x Σ ΑΣ 's 12 ½"),
    (6, "x" * 30_000),
    *[(k, "common words " * (k % 7)) for k in range(10, 300)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 1, 2, "x") for d, t in TEXTS], "doc_id long, text string, n int, rank int, ids string")


def test_pieces(docs):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = sorted(((d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in TEXTS), key=str)
    rows, dtype = packing.tokenized(docs, VOCABULARY, 2)
    assert dtype == "<u2"
    got = sorted(((r.doc_id, np.frombuffer(r.ids, dtype).tolist()) for r in rows.collect()), key=str)
    assert got == want
    pieces = packing.pack(rows, dtype, 512).cache()
    have = {}
    for r in pieces.collect():
        have.setdefault((r.sequence_id), []).append(r)
        assert len(r.ids) == 4 * r.length
    total = sum(len(ids) for _, ids in want)
    assert sorted(sum(r.length for r in v) for v in have.values())[-(total // 512) :] == [512] * (total // 512)
    joined = packing.sequences(pieces).collect()
    assert sum(r.n_tokens for r in joined) == total and all(len(r.ids) == 4 * r.n_tokens for r in joined)
    tokens = sorted(t for _, ids in want for t in ids)
    assert sorted(np.concatenate([np.frombuffer(r.ids, "<u4") for r in joined]).tolist()) == tokens
    for v in have.values():
        v.sort(key=lambda r: r.offset)
        assert [r.offset for r in v] == [0, *np.cumsum([r.length for r in v])[:-1]]
    none, dtype = packing.tokenized(docs.filter("doc_id = -1"), VOCABULARY, 2)
    assert packing.pack(none, dtype).count() == 0


def test_ids_equal_the_library_for_odd_pieces():
    definition = open(VOCABULARY).read()
    encoder, tokenizer = packing.PieceEncoder(definition, "<u2"), Tokenizer.from_file(VOCABULARY)
    texts = ["a" + chr(c) + "b " + chr(c) + " " + chr(c) + ", X" + chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts += ["J\u030c J\u030c.", "a.b, c!? 's it's I'm Été, ÀÿSSß...", "x\0|\0y z", "<|ENDOFTEXT|> <|endoftext|>,", None, ""]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoder.simple
    for _ in range(2):  # the second time from the store
        assert [np.frombuffer(b, "<u2").tolist() for b in encoder.encode(texts)] == want


def test_query(spark, sf):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op12_shortest_pack_first"](spark, sf).collect()
    for d, spans in ids.items():
        mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]] and mine[-1].start + mine[-1].length == len(spans)
        for r in mine:
            assert r.doc_tokens == len(spans)
            assert r.ids_crc32 == zlib.crc32(np.array(spans[r.start : r.start + r.length], "<u4").tobytes())
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in fill.values())


def test_running_totals_of_a_hot_key(spark):
    rows = [(0 if k % 3 else k % 50, k, k % 7, (k * 2654435761) % 2**40, f"p{k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "key long, at long, v long, x long, payload string")
    got = {r.payload: (r.s, r.y) for r in running(df, ["key"], ["at"], {"s": ("v", "sum"), "y": ("x", "xor")}).collect()}
    s, y, want = {}, {}, {}
    for key, _, v, x, payload in rows:
        s[key], y[key] = s.get(key, 0) + v, y.get(key, 0) ^ x
        want[payload] = s[key], y[key]
    assert got == want
    assert running(df.filter("at < 0"), ["key"], ["at"], {"s": ("v", "sum")}).count() == 0
