"""Periodic runs against a scan over all periods."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellframe.llm import periodic_runs
from cellframe.llm.queries import QUERIES


def scan(w, least=6, exponent=4):
    """(start, length, smallest period) of every maximal stretch, by comparing words q apart for every q."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, exponent * q):
                found.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text, rule=True):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if rule and doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = scan(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    best = (None,) * 4
    if found:
        s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


words = st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(0, k), max_size=60))
repeats = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(2, 9), st.lists(st.integers(0, 3), max_size=5)).map(
    lambda t: t[2] + t[0] * t[1] + t[0][:2] + t[2]
)


@settings(max_examples=150, deadline=None)
@given(st.lists(words | repeats, max_size=4), st.sampled_from([(6, 4), (2, 2), (3, 3), (20, 5)]))
def test_runs_equal_the_scan(docs, rule):
    first = np.r_[0, np.cumsum([len(d) for d in docs])].astype(np.int64)
    symbols = np.array([x for d in docs for x in d], np.int64)
    want = [(k, *r) for k, d in enumerate(docs) for r in scan(d, *rule)]
    assert [tuple(r) for r in periodic_runs.find(symbols, first, *rule).tolist()] == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=40))
def test_suffixes_are_sorted_and_prefixes_counted(w):
    sa = periodic_runs.SuffixArray(np.array(w), np.array([0, len(w)]))
    tails = [w[i:] + [9] for i in sa.order]
    assert tails == sorted(tails)
    for x in range(1, len(tails)):
        a, b = tails[x - 1], tails[x]
        assert sa.lcp[x] == next(k for k in range(len(a)) if a[k] != b[k])


def test_a_word_repeated_a_hundred_thousand_times():
    n = 100_000
    assert periodic_runs.find(np.zeros(n, np.int64), np.array([0, n])).tolist() == [[0, 0, n, 1]]


TEXTS = [
    (0, None),
    (1, ""),
    (2, " \t\n "),
    (3, "no " * 5),
    (4, "no " * 6 + "a b a b\na b a b"),
    (4, "no " * 6 + "a b a b\na b a b"),
    (5, "x" + " y z" * 9),
    (None, "no id " * 9),
    (7, "a b c " * 4 + "a b " * 4 + "c"),
    (8, " ".join(f"w{k % 7}" for k in range(3_000))),
    *[(k, " ".join(f"w{j}" for j in range(k % 90))) for k in range(20, 400)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "x", 1, 2) for d, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, period string, start int, n_runs int")


def test_digests(docs):
    rewritten = sorted((tuple(r) for r in periodic_runs.digests(docs, periodic_runs.repeated_tail).collect()), key=str)
    assert rewritten == sorted((expected(d, t) for d, t in TEXTS), key=str)
    plain = sorted((tuple(r) for r in periodic_runs.digests(docs).collect()), key=str)
    assert plain == sorted((expected(d, t, False) for d, t in TEXTS), key=str)
    none = docs.filter("doc_id = -1")
    assert periodic_runs.digests(none).count() == periodic_runs.runs(none).count() == 0


def test_runs_and_collapsed_texts(docs):
    some = docs.filter("doc_id in (0, 3, 4, 7)")
    got = sorted(tuple(r) for r in periodic_runs.runs(some).collect())
    assert got == [(4, 0, 6, 1), (4, 0, 6, 1), (4, 6, 8, 2), (4, 6, 8, 2), (7, 0, 14, 3), (7, 12, 8, 2)]
    texts = sorted(tuple(r) for r in periodic_runs.collapse(some).collect())
    assert texts == [(0, ""), (3, "no no no no no"), (4, "no a b"), (4, "no a b"), (7, "a b c c")]


def test_query(spark, sf):
    want = [expected(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()]
    assert sorted(got) == sorted(want)
    assert any(r[1] for r in want)
