"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order context tree over bytes. A byte costs -log2 of its probability in the longest context
of the tree that ends there; where it was never seen after that context, an escape (method C: distinct followers over
followers plus distinct followers) is paid and the next shorter context predicts it, with the bytes excluded that the
longer one already offered. Order -1 is uniform. Each language keeps all contexts that it shows MIN_COUNT times, however
many or few other languages show. The statistics are frozen after training, so the exact cost of every (context, byte)
pair is a table, and the contexts of all languages together form one automaton: a text is read once, by one table step a
byte, each state points to the longest context of each language, and a code length is a sum of table entries.

Training takes a bounded sample of labelled rows (``rows_per_lang`` documents of each language, by hash of the id) whose
n-grams Spark counts. Null text, and text without a letter, gets ``und`` with score 0; the whole text is scored. Repeated
rows are each scored; ties go to the alphabetically first language; a table without labelled rows gives ``und``."""

from __future__ import annotations


from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import STEP, arrow_batch, arrow_fields, kept, map_rows
from cellframe.spark import settle

#: Longest context in bytes.
ORDER = 4
#: Labelled documents of each language that training reads: the documented bound of the sample.
ROWS_PER_LANG = 200
#: Most languages, one short row each, whose counts are sent to every task; more are joined by a shuffle.
MAX_LANGS = 10_000
#: Fewest followers of a kept context, in its language.
MIN_COUNT = 6
#: Characters of a text whose bytes are looked up at a time.
BLOCK = 1 << 18


@dataclass
class Model:
    langs: list[str]
    symbols: bytes  # 256 bytes: the symbol of each byte; 0 is any byte that training never saw
    width: int  # symbols
    step: np.ndarray  # state * width + symbol -> next state
    rows: np.ndarray  # langs x states: the row of the longest context that the language has
    bits: np.ndarray  # rows x symbols: bits

    @property
    def cost(self) -> np.ndarray:
        """langs x (state * width + symbol): bits."""
        return self.bits[self.rows].reshape(len(self.langs), -1)

    def tables(self) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Steps from state * width + symbol to state * width, starts of rows, bits."""
        starts = list(range(0, len(self.step), self.width))  # one object a state, shared by all steps to it
        return [starts[k] for k in self.step], self.rows.astype(np.int64) * self.width, self.bits.ravel()


def training_rows(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """lang, text of a bounded sample: of each language about ``rows_per_lang`` documents with the lowest id hashes.

    Counts by language set the share of the hash range, so no group meets in one task."""
    known = docs.filter("lang is not null and text is not null")
    counts = settle(known.groupBy("lang").count())
    if counts.count() <= MAX_LANGS:
        counts = F.broadcast(counts)
    share = F.least(F.lit(1.0), F.lit(1.5 * rows_per_lang) / F.col("count"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    near = known.join(counts.select("lang", share.alias("_share")), "lang").filter(place < F.col("_share"))
    return near.select("lang", "text", F.xxhash64("doc_id", F.lit(17)).alias("_h"), "doc_id")


def _ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the (lang, n-gram) pairs of a task, n from 1 to ORDER + 1."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode()
            for n in range(1, ORDER + 2):
                counts[lang].update(data[i : i + n] for i in range(len(data) - n + 1))
    fields = arrow_fields("lang string, gram binary, n long")
    for lang, grams in counts.items():
        items = [(lang, g, n) for g, n in grams.items()]
        for at in range(0, len(items), 50_000):
            yield arrow_batch(fields, items[at : at + 50_000])


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> Model | None:
    """The frozen model of documents (doc_id, lang, text); None without a labelled row."""
    sample = training_rows(docs, rows_per_lang).select("lang", "text")
    grams = sample.mapInArrow(_ngrams, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # all n-grams of the kept contexts: at most 256 of a context
    context = F.expr("substring(gram, 1, length(gram) - 1)")
    trees = grams.groupBy("lang", context.alias("c")).agg(F.sum("n").alias("total"), F.collect_list(F.struct("gram", "n")).alias("f"))
    trees = trees.filter((F.col("total") >= MIN_COUNT) | (F.length("c") == 0)).select("lang", F.explode("f").alias("f"))
    found = trees.select("lang", "f.gram", "f.n").toArrow()  # of a bounded sample
    counts: dict[str, dict[bytes, int]] = defaultdict(dict)
    for batch in found.to_batches(max_chunksize=10_000):
        for lang, gram, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[lang][gram] = n
    return build(counts) if counts else None


def build(counts: dict[str, dict[bytes, int]]) -> Model:
    langs = sorted(counts)
    seen = sorted({g[0] for c in counts.values() for g in c if len(g) == 1})
    symbol = {b: k + 1 for k, b in enumerate(seen)}
    width = len(seen) + 1
    followers: list[dict[bytes, dict[int, int]]] = []
    for lang in langs:
        tree: dict[bytes, dict[int, int]] = defaultdict(dict)
        for g, n in counts[lang].items():
            tree[g[:-1]][symbol[g[-1]]] = n
        # a part of a kept context has no smaller count, so it is kept too
        followers.append({c: f for c, f in tree.items() if not c or sum(f.values()) >= MIN_COUNT})
    order = sorted({b""}.union(*followers), key=lambda c: (len(c), c))
    state = {c: k for k, c in enumerate(order)}
    shorter = [state[c[1:]] if c else -1 for c in order]
    rows = np.zeros((len(langs), len(order)), np.int32)
    bits: list[np.ndarray] = []
    first = 0
    sizes = 1.0 / 256
    for lang, tree in enumerate(followers):
        p = np.zeros((len(tree), width))
        k = 0
        for at_state, c in enumerate(order):
            f = tree.get(c)
            if f is None:
                rows[lang, at_state] = rows[lang, shorter[at_state]]
                continue
            below = p[rows[lang, shorter[at_state]] - first] if c else np.full(width, sizes)
            rows[lang, at_state] = first + k
            at = np.fromiter(f.keys(), np.int64, len(f))
            n = np.fromiter(f.values(), np.float64, len(f))
            if not c:  # symbol 0 stands for each of the bytes never seen
                rest = np.full(width, sizes)
                left = 1 - len(at) / 256
            else:
                rest = below
                left = max(1e-12, 1 - below[at].sum()) if len(at) < width - 1 else 1.0
            total = n.sum() + len(at)
            p[k] = rest / left * (len(at) / total)
            p[k, at] = n / total
            k += 1
        bits.append((-np.log2(np.maximum(p, 1e-30))).astype(np.float32))
        first += len(tree)
    step = np.zeros((len(order), width), np.int32)
    longer: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for c, k in state.items():
        if c:
            longer[state[c[:-1]]].append((symbol[c[-1]], k))
    for k in range(len(order)):  # shorter contexts come first
        if k:
            step[k] = step[shorter[k]]
        for b, to in longer[k]:
            step[k, b] = to
    table = bytes(symbol.get(b, 0) for b in range(256))
    return Model(langs, table, width, step.ravel(), rows, np.concatenate(bits))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.step, self.starts, self.costs = model.tables()

    def bits(self, text: str) -> np.ndarray:
        """Exact code length of the text under each language, in bits."""
        step, s = self.step, 0
        total = np.zeros(len(self.model.langs))
        for at in range(0, len(text), BLOCK):
            data = text[at : at + BLOCK].encode("utf-8", "replace").translate(self.model.symbols)
            first = s
            states = [s := step[s + b] for b in data]
            where = np.empty(len(data), np.int64)
            where[:1] = first
            where[1:] = states[:-1]
            where //= self.model.width
            symbols = np.frombuffer(data, np.uint8)
            total += [np.take(self.costs, np.take(r, where) + symbols).sum(dtype=np.float64) for r in self.starts]
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its probability given equal priors; ``und`` for text without a letter."""
        if text is None or not any(map(str.isalpha, text)):
            return "und", 0.0
        bits = self.bits(text)
        best = int(np.argmin(bits))
        return self.model.langs[best], 1.0 / sum(2.0 ** max(-1000.0, -(b - bits[best])) for b in bits)


def _scorer(model: Model) -> Scorer:
    """The scorer of a broadcast model, built once in each Python worker."""
    return kept(("langid", id(model)), lambda: Scorer(model))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of (doc_id, text); without a model ``und`` everywhere."""
    pairs = docs.select("doc_id", "text")
    if model is None:
        return pairs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a bounded sample

    def start():
        scorer = _scorer(shared.value)
        return lambda doc_id, text: [(doc_id, *scorer.predict(text))]

    return map_rows(pairs, "doc_id long, lang_pred string, score double", start)


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that have a language, with all their columns; a null ``lang`` takes the predicted one. Rows that
    get ``und`` (null text, no letter) go. Without a model only those go. Only texts go to Python, only languages back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a bounded sample

    @F.arrow_udf("string")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(shared.value) if shared.value is not None else None
        for texts in batches:
            out: list[str | None] = []
            for at in range(0, len(texts), STEP):
                some = texts.slice(at, STEP).to_pylist()
                if scorer is None:
                    out += [None if t is not None and any(map(str.isalpha, t)) else "und" for t in some]
                else:
                    out += [scorer.predict(t)[0] for t in some]
            yield pa.array(out, pa.string())

    language = language.asNondeterministic()  # or the optimizer would run it for the filter and once more for the column
    found = "_".join([*docs.columns, "found"])  # no column of docs has this name
    kept_rows = docs.withColumn(found, language(F.col("text"))).filter(F.coalesce(F.col(found) != "und", F.lit(True)))
    return kept_rows.withColumn("lang", F.coalesce("lang", found)).select(*docs.columns)
