"""Exact top-k search by inner product with MaxScore.

A term is a component. Each task groups its vectors into blocks of like ones; a block is a posting list per term with the
least and greatest component there, so that a query's term adds at least `low` and at most `high` to a score. Blocks are taken by falling
bound, until no bound reaches the k-th best score so far. Within a block the terms of least range whose ranges together don't
lift a score from the sum of the lows to that score are non-essential: a vector cannot compete by them alone. The essential
terms' postings are traversed, and the rest of a score is looked up only for vectors that are still competitive. Scores to
start from come from a bounded sample of the vectors. Each task gives its k best per query, and the lists are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import freed, keyed, tidy, written

SHARD = 8192  # vectors that are put in blocks together
BLOCK = 64  # vectors of a block, about
QUERIES = 8192  # queries that go to the tasks at once
SAMPLE = 1024  # vectors whose scores queries start from


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """vec_id, v (floor(scale * x) of every component) and the row's key; vectors that are null or hold a null or non-finite component are left out."""
    x = F.col(vector_column)
    whole = F.col(id_column).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = keyed(vectors, id_column, vector_column).where(whole)
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"), "rk_f", "rk_r")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of `width` numbers from a list column; shorter vectors are filled up with zeros."""
    out = np.zeros((len(column), width))
    n = np.diff(column.offsets.to_numpy())
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(column)), n), place] = column.flatten().to_numpy()
    return out


def key_columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(c).to_numpy() for c in ("vec_id", "rk_f", "rk_r"))


def blocks_of(vectors: np.ndarray) -> list[np.ndarray]:
    """Row numbers of blocks of like vectors: the nearest of some of the vectors, by two rounds of means, at most 2 * BLOCK in a block."""
    n = len(vectors)
    centres = vectors[:: max(1, BLOCK)].copy()
    for _ in range(2):
        near = np.argmax(vectors @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, vectors)
        count = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(count > 0, total / np.maximum(count, 1), centres)
    order = np.argsort(near, kind="stable")
    cut = np.append(np.flatnonzero(np.append(True, near[order][1:] != near[order][:-1])), n)
    return [order[i : min(i + 2 * BLOCK, b)] for a, b in zip(cut[:-1], cut[1:], strict=True) for i in range(a, b, 2 * BLOCK)]


class Best:
    """The k best answers so far of each query: scores falling, ties by smaller id; theta: what a new one has to reach."""

    def __init__(self, n: int, k: int, theta: np.ndarray | None = None):
        self.k = k
        self.found: list[list[tuple[float, int]]] = [[] for _ in range(n)]
        self.theta = np.full(n, -np.inf) if theta is None else theta.copy()

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        new = sorted([*self.found[q], *zip((-scores).tolist(), ids.tolist(), strict=True)])[: self.k]
        self.found[q] = new
        if len(new) == self.k:
            self.theta[q] = max(self.theta[q], -new[-1][0])


def search_shard(queries: np.ndarray, query_keys: tuple[np.ndarray, ...], vectors: np.ndarray, keys: tuple[np.ndarray, ...], best: Best) -> int:
    """Takes the shard's vectors into `best`; a query is never its own answer. Returns how many scores were looked up to the end."""
    groups = blocks_of(vectors)
    rows = np.concatenate(groups)
    start = np.append(0, np.cumsum([len(g) for g in groups]))
    vectors, (ids, f, r) = vectors[rows], (x[rows] for x in keys)
    low = np.minimum.reduceat(vectors, start[:-1])
    high = np.maximum.reduceat(vectors, start[:-1])
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    scored = 0
    for q, weights in enumerate(queries):
        own_f, own_r = query_keys[1][q], query_keys[2][q]
        size = np.abs(weights)
        for b in np.argsort(-bound[q], kind="stable").tolist():
            theta = best.theta[q]
            if bound[q, b] < theta:
                break
            part = slice(start[b], start[b + 1])
            reach = size * (high[b] - low[b])  # by how much each term can lift a score above the block's least
            order = np.argsort(reach)
            essential = order[np.cumsum(reach[order]) >= theta - (bound[q, b] - reach.sum())]
            rest = bound[q, b] - np.maximum(weights[essential] * high[b, essential], weights[essential] * low[b, essential]).sum()
            at = np.flatnonzero(vectors[part][:, essential] @ weights[essential] + rest >= theta) + start[b]
            at = at[(f[at] != own_f) | (r[at] != own_r)]
            if len(at):
                scores = vectors[at] @ weights
                scored += len(at)
                good = scores >= theta
                if good.any():
                    best.add(q, scores[good], ids[at[good]])
    return scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k best of the other rows; ties go to smaller vec_id.

    Both sides are tables of integer_vectors(), of one source where they share rows. Vectors stay where they are read; QUERIES queries at a time go to every
    task. A query with fewer candidates gets all. Repeated rows and rows that share a vec_id each count, as queries and as
    candidates; only the row itself is left out. Vectors of different lengths are compared as if filled up with zeros. Empty tables
    give no rows. Scores are exact below 2**53.
    """
    spark = vectors.sparkSession
    vectors, queries = written(vectors, "vectors"), written(queries, "queries")
    width = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 1, queries.agg(F.max(F.size("v"))).first()[0] or 1)
    rounds = max(1, math.ceil(queries.count() / QUERIES))
    sample = vectors.orderBy(F.xxhash64("rk_f", "rk_r"), "rk_f", "rk_r").limit(SAMPLE).toArrow().combine_chunks()
    names, out = ["query_id", "rk_f", "rk_r", "vec_id", "score"], []

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, keys, theta = shared.value
            best = Best(len(asked), k, theta)
            held, n = [], 0

            def take() -> None:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                search_shard(asked, keys, matrix(rows.column("v"), width), key_columns(rows), best)

            for batch in batches:
                for at in range(0, len(batch), SHARD):
                    held.append(batch.slice(at, SHARD))
                    n += len(held[-1])
                    if n >= SHARD:
                        take()
                        held, n = [], 0
            if n:
                take()
            of = np.repeat(np.arange(len(asked)), [len(x) for x in best.found])
            flat = [y for x in best.found for y in x]
            score, ids = (np.array([y[i] for y in flat]) for i in (0, 1))
            for i in range(0, len(of), 100_000):
                j = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[of[j]]) for x in keys), pa.array(ids[j].astype(np.int64)), pa.array(np.rint(-score[j]).astype(np.int64))], names)

        return run

    for number in range(rounds):
        with tidy(spark):
            rows = queries.where(F.pmod(F.xxhash64("rk_f", "rk_r", F.lit(3)), F.lit(rounds)) == number).toArrow().combine_chunks()
        if not len(rows):
            continue
        rows = rows.to_batches()[0]
        asked, keys = matrix(rows.column("v"), width), key_columns(rows)
        start = Best(len(asked), k)
        if len(sample):
            some = sample.to_batches()[0]
            search_shard(asked, keys, matrix(some.column("v"), width), key_columns(some), start)
        shared = spark.sparkContext.broadcast((asked, keys, start.theta))
        out.append(written(vectors.mapInArrow(freed(search(shared)), "query_id long, rk_f long, rk_r long, vec_id long, score long"), "found"))
        shared.destroy()
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lists = out[0]
    for more in out[1:]:
        lists = lists.union(more)
    rank = F.row_number().over(Window.partitionBy("rk_f", "rk_r").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
