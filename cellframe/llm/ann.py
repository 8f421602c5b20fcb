"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of each vector's nearest neighbours is cut into parts of nearly equal size with few edges
between them, and a small network learns to tell from a vector in which parts its neighbours are. Every row of the table
is put in its most probable part. A query goes to its most probable parts, and the rows there are ranked exactly, by
inner product in double precision. How many parts a query visits is measured on the sample: enough that held-out sample
vectors find at least TARGET of their true neighbours. Parts are read in blocks of bounded size, so neither a part nor a
query set meets in one task.

Equal vectors: only the k + 1 smallest ids of a vector can ever be among the k nearest, as ties go to the smaller id and
a query leaves out only itself; the others are left out of blocks, exactly. Vectors that are null, zero, of another
length than most, or hold a null or non-finite component take no part, nor do rows with a null id. Fewer candidates than
k: all of them. An empty table, or one without queries, gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cellframe.llm.common import arrow_fields
from cellframe.spark import settle

#: Bound of the sample that the partition is learned on, and neighbours of each vector in its graph.
SAMPLE, DEGREE = 6000, 16
#: Recall on held-out sample vectors that sets the number of parts to visit.
TARGET = 0.97
#: Rows of a part that are read at once, and queries that are held against them at once.
BLOCK, QUERY_BLOCK = 20_000, 5_000


@dataclass
class Router:
    """A network of one hidden layer from a vector to the probabilities of parts."""

    centre: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(0, (x - self.centre) * self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Indices of each row's nearest others by inner product, in blocks."""
    out = np.empty((len(x), degree), np.int64)
    for at in range(0, len(x), 1000):
        s = x[at : at + 1000] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + len(s)] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Parts of nearly equal size with few edges between them: nodes start with the nearest of some spread vectors, then
    move, those that gain most first, to where most of their neighbours are, while there is room."""
    n = len(x)
    rng = np.random.default_rng(5)
    heads = x[rng.choice(n, parts, replace=False)]
    room = int(np.ceil(1.05 * n / parts))
    part = _place(x @ heads.T, room)
    for _ in range(4):
        heads = np.stack([x[part == p].mean(0) if (part == p).any() else heads[p] for p in range(parts)])
        part = _place(x @ heads.T, room)
    source = np.repeat(np.arange(n), graph.shape[1])
    target = graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (source, part[target]), 1)
        np.add.at(votes, (target, part[source]), 1)
        new = _place(votes + 0.5 * (np.arange(parts) == part[:, None]), room)
        if (new == part).all():
            break
        part = new
    return part


def _place(score: np.ndarray, room: int) -> np.ndarray:
    """Each node to its best part with room left; nodes that lose most otherwise choose first."""
    first = np.sort(score, axis=1)
    order = np.argsort(-(first[:, -1] - first[:, -2]) if score.shape[1] > 1 else np.zeros(len(score)), kind="stable")
    wish = np.argsort(-score, axis=1, kind="stable")
    left, part = np.full(score.shape[1], room), np.empty(len(score), np.int64)
    for i in order:
        for p in wish[i]:
            if left[p]:
                left[p] -= 1
                part[i] = p
                break
    return part


def fit(x: np.ndarray, parts: int, k: int, target: float = TARGET) -> Router:
    """The router of a sample, with the number of parts to visit measured on a held-out tenth of it."""
    x = np.asarray(x, np.float64)
    centre = x.mean(0)
    scale = 1.0 / max(1e-12, np.sqrt(((x - centre) ** 2).sum(1).mean() / x.shape[1]))
    rng = np.random.default_rng(11)
    hidden = 128
    router = Router(centre, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, (hidden, parts)), np.zeros(parts), parts)
    if parts < 2 or len(x) < 4 * parts:
        return router
    held = np.arange(len(x)) % 10 == 0
    train, asked = x[~held], x[held]
    graph = neighbour_graph(train, min(DEGREE, len(train) - 1))
    part = balanced_parts(train, graph, parts)
    soft = np.zeros((len(train), parts))
    np.add.at(soft, (np.repeat(np.arange(len(train)), graph.shape[1]), part[graph.ravel()]), 1.0 / graph.shape[1])
    soft = 0.5 * soft + 0.5 * (np.arange(parts) == part[:, None])
    _train(router, train, soft)
    home = router.logits(train).argmax(1)
    near = np.argsort(-(asked @ train.T), axis=1)[:, : min(k, len(train))]
    wish = np.argsort(-router.logits(asked), axis=1)
    place = np.empty_like(wish)
    np.put_along_axis(place, wish, np.arange(parts)[None, :].repeat(len(wish), 0), 1)
    needed = np.take_along_axis(place, home[near], 1)
    recall = [(needed < t).mean() for t in range(1, parts + 1)]
    router.visits = next((t for t, r in enumerate(recall, 1) if r >= target), parts)
    return router


def _train(router: Router, x: np.ndarray, soft: np.ndarray, epochs: int = 40, batch: int = 256) -> None:
    """Cross entropy against soft labels, by Adam."""
    rng = np.random.default_rng(7)
    z = (x - router.centre) * router.scale
    names = ("w1", "b1", "w2", "b2")
    first = {n: np.zeros_like(getattr(router, n)) for n in names}
    second = {n: np.zeros_like(getattr(router, n)) for n in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), batch):
            rows = order[at : at + batch]
            a = z[rows]
            h = np.maximum(0, a @ router.w1 + router.b1)
            o = h @ router.w2 + router.b2
            p = np.exp(o - o.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - soft[rows]) / len(rows)
            dh = (d @ router.w2.T) * (h > 0)
            step += 1
            for n, g in zip(names, (a.T @ dh, dh.sum(0), h.T @ d, d.sum(0)), strict=True):
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                move = 3e-3 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                setattr(router, n, getattr(router, n) - move)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    v = F.col("embedding")
    odd: Column = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", v.cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    rows = rows.filter(~odd & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d").collect()
    return rows.filter(F.size("embedding") == size[0]["d"]) if size else rows


def parts_for(n: int) -> int:
    """Parts grow with the square root of the rows: a power of two from 8 to 256."""
    return min(256, max(8, 1 << int(np.ceil(np.log2(max(1.0, np.sqrt(n) / 16))))))


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    return np.array(column.to_pylist() if isinstance(column, pa.Array) else column.tolist(), np.float64)


def search(vectors: DataFrame, is_query: Column, k: int = 20, parts: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row of (vec_id, embedding) with ``is_query``."""
    rows = settle(usable(vectors))
    n = rows.count()
    parts = parts or parts_for(n)
    share = min(1.0, SAMPLE / max(1, n))
    chosen = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 24)) < share * (1 << 24)
    sample = [r["embedding"] for r in rows.filter(chosen).dropDuplicates(["embedding"]).select("embedding").collect()]  # about SAMPLE rows
    spark = rows.sparkSession
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = fit(np.array(sample), parts, k)
    shared = spark.sparkContext.broadcast(router)
    blocks = max(1, int(np.ceil(1.3 * n / parts / BLOCK)))
    fields = arrow_fields("vec_id long, embedding array<double>, part int")

    def routed(visits: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    some = batch.slice(at, 2000)
                    wish = np.argsort(-shared.value.logits(_matrix(some.column(1))), axis=1, kind="stable")[:, :visits]
                    again = pa.array(np.repeat(np.arange(some.num_rows), visits))
                    columns = [some.column(0).take(again), some.column(1).take(again), pa.array(wish.ravel().astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, (_, t) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])

        return run

    schema = "vec_id long, embedding array<double>, part int"
    first = W.partitionBy("embedding").orderBy("vec_id")
    kept = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1).drop("_n")
    homes = kept.mapInArrow(routed(1), schema)
    asked = rows.filter(is_query)
    query_blocks = max(1, int(np.ceil(asked.count() * router.visits / parts / QUERY_BLOCK)))
    asked = asked.mapInArrow(routed(router.visits), schema)
    block, query_block = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)), F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(query_blocks))
    every_block, every_query_block = (F.explode(F.sequence(F.lit(0), F.lit(b - 1))) for b in (blocks, query_blocks))
    homes = homes.withColumn("block", block.cast("int")).withColumn("qblock", every_query_block)
    asked = asked.withColumn("qblock", query_block.cast("int")).withColumn("block", every_block)
    keys = ("part", "block", "qblock")
    found = asked.groupBy(*keys).cogroup(homes.groupBy(*keys)).applyInPandas(lambda q, c: _nearest(q, c, k), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of a block to each query of a block, scored one by one in double precision."""
    out: list[tuple[np.ndarray, ...]] = []
    if len(queries) and len(rows):
        ids, x = rows["vec_id"].to_numpy(), _matrix(rows["embedding"])
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        for at in range(0, len(queries), 256):
            q_ids, q = queries["vec_id"].to_numpy()[at : at + 256], _matrix(queries["embedding"].iloc[at : at + 256])
            s = q @ x.T
            s[q_ids[:, None] == ids[None, :]] = -np.inf
            m = min(k, len(ids))
            edge = np.partition(s, len(ids) - m, axis=1)[:, len(ids) - m]
            edge = edge - 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
            for i, q_id in enumerate(q_ids):
                near = np.flatnonzero((s[i] >= edge[i]) & np.isfinite(s[i]))
                score = (x[near] * q[i]).sum(1)
                best = np.lexsort((ids[near], -score))[:k]
                out.append((np.full(len(best), q_id), ids[near][best], score[best]))
    if not out:
        return pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], np.float64)})
    return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})
