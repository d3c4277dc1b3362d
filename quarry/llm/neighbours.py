"""Approximate nearest neighbours over learned partitions.

From a bounded sample (``SAMPLE`` vectors, by a hash of the id) the exact neighbour graph is built and cut into balanced
parts: vertices are first split in halves along principal directions, then move to the part that holds most of their
neighbours as long as no part outgrows its share. A small network learns, from a vector, the parts of its neighbours.
Every row of the table is stored under its most probable part; a query goes to its ``probes`` most probable parts, and
all their vectors are reranked by exact Euclidean distance in double precision. ``probes`` is the smallest number that
finds ``RECALL`` of the true neighbours of sample queries within the sample.

The number of parts follows the table (about ``MEAN_ROWS`` vectors each), as far as the sample can teach them apart. A part
of more than ``PART_ROWS`` vectors is cut into chunks that are searched on their own, so that a part which holds most
rows (one vector repeated) spreads over the cluster; the queries that ask for a part are dealt to blocks of about
``QUERY_ROWS``, so that a task compares one block with one chunk, and a chunk is sent once for each block that asks for
its part. Each returns its k nearest, and the k best of all stay.

Defined results: null vectors, zero vectors, vectors with a null or non-finite component, vectors of another length
than the most common one (ties: the longer), which have no distance to the others, and rows with a null id, which can't
be named, take no part, neither as queries nor as candidates. Rows are told apart by their place, not by their id: rows
that repeat an id are queries and candidates one by one, and a query's candidates are all rows but itself. Fewer
candidates than k: all. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import keep

#: Vectors of the sample from which parts are learned, and fewest of them that teach a part.
SAMPLE, TAUGHT = 8192, 64
#: Rows of a part on average, rows of it searched in one task, and queries of a task.
MEAN_ROWS, PART_ROWS, QUERY_ROWS = 2048, 16384, 4096
RECALL = 0.95
_FOUND = "query_row long, query_id long, vec_id long, score double"
_ROUTED = "row long, vec_id long, vector array<double>, part int"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(table: DataFrame, id_col: str, vector_col: str, asked: Column) -> DataFrame:
    """row (a number of its own), vec_id, vector (doubles) and asked of the rows that take part; in the shared folder."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows if length is None else rows.where(F.size("vector") == length[0])


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1)


def _near(x: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Rows of x nearest to each query, without row ``own[i]`` for query i."""
    squares = (x * x).sum(1)
    out = np.empty((len(queries), k), np.int64)
    for low in range(0, len(queries), 512):
        part = queries[low : low + 512]
        far = squares[None] - 2 * part @ x.T
        if own is not None:
            far[np.arange(len(part)), own[low : low + 512]] = np.inf
        out[low : low + len(part)] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """A part for each vertex of the neighbour graph; parts (a power of two) of at most ``slack`` times the mean size."""
    part = np.zeros(len(x), np.int64)
    while part.max() + 1 < parts:
        split = np.zeros(len(x), np.int64)
        for p in range(part.max() + 1):
            own = np.flatnonzero(part == p)
            centred = x[own] - x[own].mean(0)
            direction = np.linalg.svd(centred[:: max(1, len(own) // 1024)], full_matrices=False)[2][0]
            order = np.argsort(centred @ direction, kind="stable")
            split[own[order[len(own) // 2 :]]] = 1
        part = 2 * part + split
    ends = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()], 1), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])], 1)])
    room = int(np.ceil(slack * len(x) / parts))
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        held = np.zeros((len(x), parts), np.int32)
        np.add.at(held, (ends[:, 0], part[ends[:, 1]]), 1)
        best = held.argmax(1)
        gain = held.max(1) - held[np.arange(len(x)), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if size[best[v]] < room:
                size[part[v]] -= 1
                size[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if moved < len(x) // 500:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer: chances of the parts from a vector."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def odds(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2


def train_router(x: np.ndarray, goal: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 4) -> Router:
    """Cross entropy against ``goal`` (shares of each vector's neighbours by part), by Adam in batches."""
    draw = np.random.default_rng(seed)
    mean = x.mean(0)
    scale = float(np.sqrt(((x - mean) ** 2).mean())) or 1.0
    z = (x - mean) / scale
    shape = [(z.shape[1], hidden), (hidden,), (hidden, goal.shape[1]), (goal.shape[1],)]
    theta = [draw.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s) for s in shape]
    first, second, t = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape], 0
    for epoch in range(epochs):
        order = draw.permutation(len(z))
        for low in range(0, len(z), 256):
            a, y = z[order[low : low + 256]], goal[order[low : low + 256]]
            h = a @ theta[0] + theta[1]
            r = np.maximum(h, 0)
            o = r @ theta[2] + theta[3]
            p = np.exp(o - o.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - y) / len(a)
            back = d @ theta[2].T * (h > 0)
            t += 1
            for k, g in enumerate((a.T @ back, back.sum(0), r.T @ d, d.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = 3e-3 * (1 - epoch / epochs)
                theta[k] = theta[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, *theta)


def fit(table: DataFrame, parts: int | None = None, k: int = 10, sample: int = SAMPLE, recall: float = RECALL) -> Router | None:
    """Learn parts from a bounded sample of ``table`` (row, vec_id, vector); None where there is too little to divide."""
    if parts is None:
        parts = 1 << max(3, (table.count() // MEAN_ROWS).bit_length())
    rows = table.select("row", "vec_id", "vector").orderBy(F.xxhash64("vec_id", "row"), "vec_id", "row").limit(sample).toArrow()
    x = _matrix(rows.column("vector"), rows.num_rows) if rows.num_rows else np.zeros((0, 1))
    while parts > 1 and len(x) < TAUGHT * parts:
        parts //= 2
    if parts < 2:
        return None
    graph = _near(x, x, k, np.arange(len(x)))
    part = balanced_parts(x, graph, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), k), part[graph].ravel()), 1)
    np.add.at(goal, (np.arange(len(x)), part), 1)
    # probes are chosen by vectors that the network hasn't seen; the network that is used has seen all
    held = np.arange(len(x)) % 5 == 0
    trial = train_router(x[~held], goal[~held] / goal[~held].sum(1, keepdims=True))
    odds = trial.odds(x)
    stored = odds.argmax(1)
    rank = (-odds[held]).argsort(1).argsort(1)
    needed = np.take_along_axis(rank, stored[graph[held]], 1).ravel()
    probes = int(np.quantile(needed, recall, method="higher")) + 1
    router = train_router(x, goal / goal.sum(1, keepdims=True))
    router.probes = min(parts, probes)
    return router


def _route(router: Router | None, probes: int):
    """row, vec_id and vector with each of the ``probes`` most probable parts."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if router is None:
                part, times = np.zeros((n, 1), np.int64), 1
            else:
                times = min(probes, len(router.b2))
                part = np.argsort(-router.odds(_matrix(batch.column(2), n)), axis=1, kind="stable")[:, :times]
            again = pa.array(np.repeat(np.arange(n), times))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(again) for i in range(3)), pa.array(part.ravel().astype(np.int32))], names=["row", "vec_id", "vector", "part"])

    return route


def _rerank(k: int):
    """A block of queries and the vectors of one chunk to the k nearest of each query."""

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        own_rows, queries, q = left.column("row").to_numpy(), left.column("vec_id").to_numpy(), _matrix(left.column("vector"), left.num_rows)
        rows, ids, x = right.column("row").to_numpy(), right.column("vec_id").to_numpy(), _matrix(right.column("vector"), right.num_rows)
        # the quick form of the distance only rules out rows; its error is far below the margin
        squares = (x * x).sum(1)
        found: list[tuple[np.ndarray, ...]] = []
        for i in range(len(q)):
            own = float(q[i] @ q[i])
            quick = squares - 2 * (x @ q[i]) + own
            quick[rows == own_rows[i]] = np.inf
            near = np.arange(len(x))
            if len(x) > k:
                most = np.partition(quick, k - 1)[k - 1]
                near = np.flatnonzero(quick <= most + 1e-9 * (own + np.abs(most) + 1)) if np.isfinite(most) else near
            near = near[rows[near] != own_rows[i]]
            score = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
            best = np.lexsort((ids[near], score))[:k]
            found.append((np.full(len(best), own_rows[i]), np.full(len(best), queries[i]), ids[near[best]], score[best]))
        columns = [np.concatenate([f[j] for f in found]) for j in range(4)]
        return pa.table(dict(zip(("query_row", "query_id", "vec_id", "score"), columns, strict=True)))

    return rerank


def nearest(table: DataFrame, asked: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, parts: int | None = None, probes: int | None = None) -> DataFrame:
    """The k nearest rows of ``table`` to each of its rows for which ``asked`` holds: query_id, rank (from 1), vec_id, score.

    ``parts`` and ``probes`` override the number of parts, and the learned number of them that a query visits.
    """
    rows = vectors(table, id_col, vector_col, asked)
    router = fit(rows, parts, k)
    stored = keep(rows.select("row", "vec_id", "vector").mapInArrow(_route(router, 1), _ROUTED), "parts")
    queries = rows.where("asked").select("row", "vec_id", "vector")
    asked_at = keep(queries.mapInArrow(_route(router, probes or (router.probes if router else 1)), _ROUTED), "asked")
    chunks = F.broadcast(stored.groupBy("part").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("chunks")))  # a row for each part
    blocks = F.broadcast(asked_at.groupBy("part").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks")))  # so here
    stored = stored.join(chunks, "part").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks").cast("long")).cast("int"))
    stored = stored.join(blocks, "part").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    asked_at = asked_at.join(chunks, "part").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
    asked_at = asked_at.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks").cast("long")).cast("int"))
    key, shape = ("part", "chunk", "block"), ("part", "chunk", "block", "row", "vec_id", "vector")
    found = asked_at.select(*shape).groupBy(*key).cogroup(stored.select(*shape).groupBy(*key)).applyInArrow(_rerank(k), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
