"""Toxicity by a gap-weighted subsequence kernel, a support vector machine and Nyström landmarks.

Two strings are alike as far as they share subsequences of three characters; a subsequence counts DECAY to the power of
the characters it spans, up to SPAN, so that one or two inserted or foreign characters weaken a match but do not break
it. Strings are the words of a text between marks for their ends; letters spelled out one by one form one string again.

Training is by multiple instances. A toxic document holds at least one toxic string, but its label does not say which.
Witnesses are the strings that toxic documents share more often than chance allows and others lack. Where many strings
share the very same documents (words of a copied passage), only so many of them are taken that each of these documents
holds a witness. They are the positive examples, strings of other documents
the negative ones, and a second round adds the negative strings that the first machine scores highest. The kernel is
reduced to landmarks: with the landmarks' kernel matrix K, a string's features are K**-1/2 times its kernel values, and a
linear machine is trained on them by gradient steps on the squared hinge. The kernel has finitely many subsequences, so
the machine folds into one weight a subsequence. A document's score is a logistic function of its strongest strings.

Training reads a bounded sample of labelled rows (``max_toxic``, ``max_other``, by hash of the id). Null and empty texts
score as a text without a toxic string. Repeated rows score alike. Without labels of both kinds every score is the share
of toxic labels (0 without labels)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import arrow_batch, arrow_fields, map_rows, text_slices
from cellframe.spark import settle

LENGTH, SPAN, DECAY = 3, 5, 0.7
#: Bounds of the labelled sample, and of the machine.
MAX_TOXIC, MAX_OTHER = 1500, 5000
LANDMARKS, NEGATIVES = 300, 4000
#: Longest string; longer words are read in overlapping pieces of this size.
LONGEST = 40
CACHE_WORDS = 300_000
#: Letters of the screening table, those of most weight: with marks and two spare codes they fit one byte.
CODES = 250
#: Strongest strings that the score of a document looks at.
TOP = 3
#: Values up to CUT count as FLOOR: far from any toxic string.
CUT, FLOOR = -0.6, -1.0
#: Strings that share their documents with so many others are words of a copied passage, which needs few witnesses.
TWINS = 4

_SPELLED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_MARKS = re.compile(r"[\W_]+")
_EDGE = " \t\r\n\x0b\x0c.,;:!?*#%&$\"'()[]{}|<>~`^=+/\\_-"


def forms(word: str) -> list[str]:
    """The strings that a lower-case word stands for: itself without edge marks, itself without any marks, in pieces if
    it is very long."""
    word = word.strip(_EDGE)
    if len(word) > LONGEST:
        return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]
    if len(word) < 2:
        return []
    return [word] if word.isalnum() or len(plain := _MARKS.sub("", word)) < 2 else [word, plain]


def raw_words(text: str | None) -> set[str]:
    """The distinct words of a text in lower case, with letters that were spelled out put together."""
    if not text:
        return set()
    text = text.lower()
    words = set(text.split())
    words.update("".join(m[0].split()) for m in _SPELLED.finditer(text))
    return words


def strings(text: str | None) -> set[str]:
    """The distinct strings of a text."""
    return {s for w in raw_words(text) for s in forms(w)}


def features(word: str) -> dict[str, float]:
    """Subsequences of the word between its end marks, with their weights, at unit length."""
    w = f"^{word}$"
    n, out = len(w), {}
    for i in range(n - 2):
        for k in range(i + 2, min(n, i + SPAN)):
            weight = _WEIGHT[k - i]
            for j in range(i + 1, k):
                u = w[i] + w[j] + w[k]
                out[u] = out.get(u, 0.0) + weight
    size = math.sqrt(sum(v * v for v in out.values())) or 1.0
    return {u: v / size for u, v in out.items()}


_WEIGHT = [DECAY**d for d in range(SPAN + 1)]


def kernel(a: list[dict[str, float]], b: list[dict[str, float]]) -> np.ndarray:
    """Kernel values of all pairs of two short lists."""
    columns: dict[str, list[tuple[int, float]]] = {}
    for j, f in enumerate(b):
        for u, v in f.items():
            columns.setdefault(u, []).append((j, v))
    out = np.zeros((len(a), len(b)))
    for i, f in enumerate(a):
        for u, v in f.items():
            for j, x in columns.get(u, ()):
                out[i, j] += v * x
    return out


@dataclass
class Model:
    base: float  # share of toxic labels
    weights: dict[str, float] = field(default_factory=dict)  # of subsequences
    bias: float = 0.0
    document: list[float] = field(default_factory=list)  # of the strongest strings, then the constant


def _sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_other: int) -> DataFrame:
    """doc_id, toxic, text of about ``max_toxic`` toxic and ``max_other`` other labelled rows, by hash of the id."""
    known = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = settle(known)
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, max_toxic / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, max_other / max(1, n.get(0, 0)))))
    chosen = known.filter(place < share * F.lit(1 << 20))
    # about max_toxic + max_other ids of 12 bytes: a bound by parameter
    return settle(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> Model:
    """The machine for labelled documents: docs (doc_id, text), labels (doc_id, toxic)."""
    sample = _sample(docs, labels, max_toxic, max_other)

    def start():
        return lambda doc_id, toxic, text: [(doc_id, toxic, s) for s in strings(text)]

    found = map_rows(sample.dropDuplicates(["text"]).select("doc_id", "toxic", "text"), "doc_id long, toxic int, s string", start)
    found = settle(found)
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = size.get(1, 0), size.get(0, 0)
    if not toxic or not other:
        return Model(toxic / max(1, toxic + other))
    by_string = settle(found.groupBy("s").agg(F.sum("toxic").alias("hits"), F.count("*").alias("n")))
    # so many hits that chance would give them to less than a tenth of a string
    least = max(3, math.ceil(math.log(10 * max(10, by_string.count())) / -math.log(toxic / (toxic + other))))
    rare = (F.col("n") - F.col("hits")) * 20 <= F.col("hits")
    shared = by_string.filter((F.col("hits") >= least) & rare).select("s")
    has: dict[str, set[int]] = {}
    for r in found.filter("toxic = 1").join(shared, "s").select("s", "doc_id").collect():  # of the bounded sample
        has.setdefault(r["s"], set()).add(r["doc_id"])
    witnesses = _witnesses(has)
    spread = F.xxhash64("s", F.lit(31))
    negatives = [r["s"] for r in by_string.filter("hits = 0 or n > 3 * hits").orderBy(F.desc(F.col("n") > 20), spread).limit(NEGATIVES).select("s").collect()]
    if not witnesses:
        return Model(toxic / (toxic + other))
    witnesses = sorted({v for w in witnesses for v in _with_noise(w)})
    weights, bias = _machine(witnesses, negatives, [])
    model = Model(toxic / (toxic + other), weights, bias)
    shared_model = sample.sparkSession.sparkContext.broadcast(model)

    def hard():
        scorer = Scorer(shared_model.value)
        return lambda s: [(s, scorer.exact(s))]

    worst = map_rows(found.filter("toxic = 0").select("s").distinct(), "s string, f double", hard)
    worst = [r["s"] for r in worst.orderBy(F.desc("f"), "s").limit(NEGATIVES // 4).collect()]
    model.weights, model.bias = _machine(witnesses, negatives, worst)
    x, y = _document_scores(sample, model)
    model.document = _logistic(x, y)
    return model


def _witnesses(has: dict[str, set[int]]) -> list[str]:
    """Strings whose documents are their own; of the strings of whole passages, those with most documents first, so many
    that every document of the passage holds a witness."""
    names = sorted(has)
    ids = {d: k for k, d in enumerate(sorted(set().union(*has.values())))} if has else {}
    holds = np.zeros((len(names), len(ids)), np.float32)
    for i, s in enumerate(names):
        holds[i, [ids[d] for d in has[s]]] = 1
    out, passages = [], []
    size = holds.sum(1)
    for i, s in enumerate(names):
        both = holds @ holds[i]
        twins = int((both >= 0.5 * (size + size[i] - both)).sum()) - 1
        (out if twins < TWINS else passages).append(s)
    explained = set().union(*(has[s] for s in out))
    for s in sorted(passages, key=lambda s: (-len(has[s]), -len(s), s)):
        if not has[s] <= explained:
            out.append(s)
            explained |= has[s]
    return sorted(out)


def _with_noise(word: str) -> list[str]:
    """A witness and two forms of it with a foreign character inside, as people write to slip past a list."""
    inner = [1 + len(word) // 3, 1 + 2 * len(word) // 3]
    return [word, *(word[:i] + c + word[i:] for i, c in zip(inner, "*x", strict=True) if i < len(word))]


def _machine(positive: list[str], negative: list[str], hard: list[str], rounds: int = 3000) -> tuple[dict[str, float], float]:
    """Nyström features and a linear machine on them, folded into weights of subsequences."""
    positive, hard = sorted(positive), sorted(set(hard) - set(positive))
    plain = sorted(set(negative) - set(positive) - set(hard))
    third = LANDMARKS // 3
    marks = [x for xs in (positive, hard, plain) for x in xs[:: max(1, math.ceil(len(xs) / third))]]
    negative = hard + plain
    mark_features = [features(m) for m in marks]
    values, vectors = np.linalg.eigh(kernel(mark_features, mark_features))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = kernel([features(s) for s in positive + negative], mark_features) @ root
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    c = np.where(y > 0, 0.3 / len(positive), 3.0 / max(1, len(negative)))
    w, b, v, vb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    rate, ridge = 0.3, 1e-5
    for _ in range(rounds):  # accelerated gradient on the squared hinge
        slack = np.maximum(0, 1 - y * (x @ w + b)) * c * y
        gw, gb = ridge * w - x.T @ slack, -slack.sum()
        v, vb = 0.9 * v - rate * gw, 0.9 * vb - rate * gb
        w, b = w + v, b + vb
    beta = root @ w
    weights: dict[str, float] = {}
    for f, k in zip(mark_features, beta, strict=True):
        for u, value in f.items():
            weights[u] = weights.get(u, 0.0) + k * value
    return weights, float(b)


class Scorer:
    """Scores texts; values of words are kept, unknown words of many texts are valued at once."""

    def __init__(self, model: Model):
        self.model = model
        self._cache: dict[str, float] = {}
        weight: dict[str, float] = dict.fromkeys(sorted({c for u in model.weights for c in u} - {"^", "$"}), 0.0)
        for u, v in model.weights.items():
            for c in set(u) - {"^", "$"}:
                weight[c] += abs(v)
        ranked = sorted(weight, key=lambda c: (-weight[c], c))
        letters = sorted(ranked[:CODES])
        # code 0 is a letter of the model without a place in the table, code 1 one that the model does not know
        self._code = dict.fromkeys(map(ord, ranked[CODES:]), chr(0)) | {ord(c): chr(k + 4) for k, c in enumerate(letters)} | {ord("^"): chr(2), ord("$"): chr(3)}
        self._width = len(letters) + 4
        self._theta = np.zeros(self._width**3, np.float32)
        place = {c: k + 4 for k, c in enumerate(letters)} | {"^": 2, "$": 3}
        for u, v in model.weights.items():
            if all(c in place for c in u):
                self._theta[(place[u[0]] * self._width + place[u[1]]) * self._width + place[u[2]]] = v
        self._letters = _Codes(self._code)
        self._norms = [1.0] * 3 + [math.sqrt(sum(_WEIGHT[k] ** 2 * (k - 1) * max(0, n - k) for k in range(2, SPAN))) or 1.0 for n in range(3, LONGEST + 3)]

    def exact(self, s: str) -> float:
        """The machine's value of one string."""
        get = self.model.weights.get
        return sum([v * get(u, 0.0) for u, v in features(s).items()]) + self.model.bias

    def string(self, s: str) -> float:
        """The value of one string, FLOOR up to CUT."""
        f = self.exact(s)
        return min(3.0, f) if f > CUT else FLOOR

    def learn(self, words: set[str]) -> None:
        """Value words that are not kept yet. Unscaled sums of all their strings come from one table; only where these
        could exceed CUT (a string's length is at least that without repeated subsequences), or where a string has a
        letter of the model that the table lacks, is the exact value taken."""
        if len(self._cache) + len(words) > CACHE_WORDS:
            self._cache.clear()
        self._cache.update(dict.fromkeys(words, FLOOR))
        pairs = [(w, s) for w in words for s in forms(w)]
        if not pairs or not self.model.weights:
            return
        marked = [f"^{s}$" for _, s in pairs]
        code = np.frombuffer("".join(marked).translate(self._letters).encode("latin-1"), np.uint8).astype(np.int32)
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        end = np.cumsum(size)
        stop = np.repeat(end, size)
        at = np.arange(len(code))
        total = np.zeros(len(code), np.float32)
        a = code * (self._width * self._width)
        for k in range(2, SPAN):
            inside = at[: len(code) - k][at[: len(code) - k] + k < stop[: len(code) - k]]
            for j in range(1, k):
                total[inside] += _WEIGHT[k] * self._theta[a[inside] + code[inside + j] * self._width + code[inside + k]]
        sums = np.add.reduceat(total, end - size)
        norm = np.array(self._norms)[np.minimum(size, len(self._norms) - 1)]
        beyond = np.logical_or.reduceat(code == 0, end - size)
        for i in np.flatnonzero(beyond | (np.maximum(sums, 0) / norm + self.model.bias > CUT - 1e-3)):
            w, s = pairs[i]
            self._cache[w] = max(self._cache[w], self.string(s))

    def top(self, texts: list[str | None]) -> list[list[float]]:
        """For each text the values of its strongest strings, strongest first, filled up with FLOOR."""
        out = []
        for at in range(0, len(texts), 32):
            words = [raw_words(t) for t in texts[at : at + 32]]
            known = self._cache
            new = {w for ws in words for w in ws if w not in known}
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = set().union(*words)
            self.learn(new)
            for ws in words:
                best = sorted([v for w in ws if (v := known[w]) > FLOOR], reverse=True)[:TOP]
                out.append(best + [FLOOR] * (TOP - len(best)))
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        if not self.model.document:
            return [self.model.base] * len(texts)
        z = np.array([[*t, 1.0] for t in self.top(texts)]) @ np.array(self.model.document)
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


class _Codes(dict):
    def __missing__(self, key):
        return chr(1)


def _document_scores(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(shared.value)
        return lambda toxic, text: [(toxic, scorer.top([text])[0])]

    rows = map_rows(sample.select("toxic", "text"), "toxic int, top array<double>", start).collect()  # a bounded sample
    return np.array([[*r["top"], 1.0] for r in rows]), np.array([float(r["toxic"]) for r in rows])


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> list[float]:
    """Logistic regression by Newton steps; other texts count a little more, coefficients of strings stay above zero."""
    c = np.where(y > 0, 0.4 / max(1, y.sum()), 0.6 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 0.5 * np.r_[np.ones(len(w) - 1), 0.0]
        h = (x * (c * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        w = w - np.clip(np.linalg.solve(h, x.T @ (c * (p - y)) + ridge * w), -2, 2)
        w[:-1] = np.maximum(w[:-1], 0.0)
    return w.tolist()


_SCORERS: dict[int, Scorer] = {}


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score, predicted (1 from 0.5) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand subsequences

    fields = arrow_fields("doc_id long, score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        for part in text_slices(batches, 1):
            scores = _SCORERS[key].scores(part.column(1).to_pylist())
            yield arrow_batch(fields, [(d, s, int(s >= 0.5)) for d, s in zip(part.column(0).to_pylist(), scores, strict=True)])

    pairs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return pairs.mapInArrow(run, "doc_id long, score double, predicted int")
