"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample of vectors is cut into balanced parts with few edges
between them; a small network learns, from a vector alone, in which parts its neighbours
lie.  Every row is indexed under its most probable part.  A query goes to its most probable
parts, as many as a held-out part of the sample needs for ``TARGET`` recall, and their rows
are compared exactly.  Where vectors have no structure that is most of the parts: recall
is held, and time is not saved.

Parts are met in blocks of rows and queries, so a part, or a vector with many copies, is
never in one task as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basinlens.llm.common import sampled, written

FIT_ROWS = 6_000  # sample for graph and network, smallest id hashes first
HELD_OUT = 600  # of them, to choose the number of parts to search
GRAPH_NEIGHBOURS = 10
ROWS_PER_PART = 400  # wanted; there are between MIN_PARTS and MAX_PARTS parts
MIN_PARTS, MAX_PARTS = 4, 64
HIDDEN = 96
TARGET = 0.94
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_000  # of one meeting


def _nearest(x: np.ndarray, y: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Positions in ``y`` of the ``k`` nearest of each row of ``x`` (not itself if ``own``), in blocks."""
    k = min(k, len(y) - own)
    out = np.empty((len(x), k), dtype=np.int64)
    norms = (y**2).sum(axis=1)
    for a in range(0, len(x), 500):
        d = norms - 2 * x[a : a + 500] @ y.T
        if own:
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 500] = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.argsort(d, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1) -> np.ndarray:
    """Parts of about equal size with few graph edges between them.

    Starts from median splits along main directions; then each node in turn moves to the
    part with most of its neighbours that is not full.
    """
    n = len(x)
    part = np.zeros(n, dtype=np.int64)
    groups = [np.arange(n)]
    while len(groups) < parts:
        largest = max(range(len(groups)), key=lambda i: len(groups[i]))
        rows = groups.pop(largest)
        centred = x[rows] - x[rows].mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = np.argsort(centred @ direction, kind="stable")
        groups += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    for i, rows in enumerate(groups):
        part[rows] = i
    edges = [set(row.tolist()) for row in graph]
    for a, row in enumerate(graph):
        for b in row:
            edges[b].add(a)
    around = [np.fromiter(e, dtype=np.int64) for e in edges]
    sizes = np.bincount(part, minlength=parts).astype(float)
    room = max(1.0, slack * n / parts)
    for _ in range(rounds):
        moved = 0
        for v in range(n):
            votes = np.bincount(part[around[v]], minlength=parts) - 0.5 * sizes / room
            votes[(sizes >= room) & (np.arange(parts) != part[v])] = -np.inf
            best = int(votes.argmax())
            if best != part[v]:
                sizes[part[v]] -= 1
                sizes[best] += 1
                part[v] = best
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer: scores of the parts for a vector."""

    centre: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 256, seed: int = 7) -> Router:
    """Cross entropy against each row's distribution over parts, by Adam."""
    rng = np.random.default_rng(seed)
    dims, parts = x.shape[1], target.shape[1]
    centre = x.mean(axis=0)
    scale = 1 / max(1e-9, float((x - centre).std()))
    w = [rng.normal(0, scale * (2 / dims) ** 0.5, (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            rows = order[a : a + batch]
            xb, yb = x[rows] - centre, target[rows]
            h = np.maximum(xb @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - yb) / len(rows)
            dh = (dz @ w[2].T) * (h > 0)
            grads = [xb.T @ dh + 1e-5 * w[0], dh.sum(axis=0), h.T @ dz + 1e-5 * w[2], dz.sum(axis=0)]
            step += 1
            rate = 3e-3 * (1 - epoch / epochs)
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                size = (scale if i == 0 else 1.0) * rate
                w[i] = w[i] - size * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-12)
    return Router(centre, *w)


def fit_router(sample: np.ndarray, rows: int, k: int) -> tuple[Router, int]:
    """The router and the number of parts to search, from a sample of a table of ``rows`` rows."""
    x = np.unique(sample, axis=0)  # copies would be neighbours of each other alone
    x = x[np.random.default_rng(3).permutation(len(x))]
    parts = int(min(MAX_PARTS, max(MIN_PARTS, rows // ROWS_PER_PART)))
    held = x[: min(HELD_OUT, len(x) // 10)]
    fit = x[len(held) :]
    if len(fit) < 10 * parts:
        none = np.zeros((sample.shape[1], 1))
        return Router(np.zeros(sample.shape[1]), none, np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1
    graph = _nearest(fit, fit, GRAPH_NEIGHBOURS, own=True)
    part = balanced_parts(fit, graph, parts)
    one_hot = np.eye(parts)
    target = (one_hot[part] + one_hot[part[graph]].mean(axis=1)) / 2
    router = train_router(fit, target)
    placed = router.scores(fit).argmax(axis=1)
    ranks = np.argsort(np.argsort(-router.scores(held), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(ranks, placed[_nearest(held, fit, k, own=False)], axis=1)
    recall = np.array([(needed < probes).mean() for probes in range(1, parts + 1)])
    return router, int(np.argmax(recall >= TARGET)) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _index(batches: Iterator[pa.RecordBatch], router) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            part = router.value.scores(_matrix(batch.column("v"))).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], ["vec_id", "v", "part"])


def _route(batches: Iterator[pa.RecordBatch], router, probes: int, sizes: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """A row per query and part to search; more than ``probes`` where those may hold fewer than ``k`` rows of other ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        order = np.argsort(-router.value.scores(_matrix(batch.column("v"))), axis=1, kind="stable")
        wanted = k + batch.column("copies").to_numpy()
        enough = (np.cumsum(sizes[order], axis=1) < wanted[:, None]).sum(axis=1) + 1
        counts = np.minimum(np.maximum(probes, enough), order.shape[1])
        rows = np.repeat(np.arange(len(order)), counts)
        parts = np.concatenate([order[i, :c] for i, c in enumerate(counts)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(rows)), batch.column("v").take(pa.array(rows)), pa.array(parts)], ["query_id", "q", "part"]
        )


def _compare(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest rows of one block for each query of another, by exact distance and then id."""
    out: list[list] = [[], [], []]
    if left.num_rows and right.num_rows:
        right = right.sort_by("vec_id")
        ids = right.column("vec_id").to_numpy()
        rows, queries = _matrix(right.column("v").combine_chunks()), _matrix(left.column("q").combine_chunks())
        norms = (rows**2).sum(axis=1)
        own = left.column("query_id").to_numpy()
        for a in range(0, len(queries), 200):
            block = queries[a : a + 200]
            near = norms - 2 * block @ rows.T + (block**2).sum(axis=1)[:, None]
            near[own[a : a + 200, None] == ids[None, :]] = np.inf
            last = min(k, near.shape[1]) - 1
            bound = np.partition(near, last, axis=1)[:, last]
            for i, query in enumerate(block):
                # the product form is exact to about 1e-12 of the lengths
                at = np.flatnonzero(near[i] <= bound[i] + 1e-9 * (1 + norms.max(initial=0.0)))
                at = at[ids[at] != own[a + i]]
                exact = np.sqrt(((rows[at] - query) ** 2).sum(axis=1))
                best = np.argsort(exact, kind="stable")[:k]  # rows are in order of id
                out[0] += [own[a + i]] * len(best)
                out[1] += ids[at[best]].tolist()
                out[2] += exact[best].tolist()
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of rows that take part: an id, and a finite vector that is not zero, of the most frequent length."""
    v = F.col(vector).cast("array<double>")
    good = vectors.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    )
    length = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (length["n"] if length else 0))


def nearest(vectors: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for the rows that ``queries`` selects.

    ``score`` is the Euclidean distance in double precision; equal ones rank by id.  All
    rows are searched but those with the query's own id.  Null or zero vectors, those with
    null or non-finite components, of another length than most, or without an id take no
    part.  Rows of one id are found each for itself; an id asks once, with the smallest of its vectors.  An empty table
    gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, key, vector), "vectors")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = sampled(rows, FIT_ROWS, ["vec_id"]).orderBy(F.xxhash64("vec_id"), "vec_id", "v").select("v").toArrow()
    model, probes = fit_router(_matrix(sample.column("v").combine_chunks()), total, k)
    router = spark.sparkContext.broadcast(model)  # its size is the network's
    indexed = rows.mapInArrow(partial(_index, router=router), "vec_id bigint, v array<double>, part int")
    indexed = written(indexed, "index")
    sizes = np.zeros(len(model.b2), dtype=np.int64)
    for r in indexed.groupBy("part").count().collect():  # one row per part
        sizes[r["part"]] = r["count"]
    copies = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("copies"))
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v")).join(copies, "vec_id")
    routed = asked.mapInArrow(
        partial(_route, router=router, probes=probes, sizes=sizes, k=k), "query_id bigint, q array<double>, part int"
    )
    routed = written(routed, "routed")
    asking = np.zeros(len(sizes), dtype=np.int64)
    for r in routed.groupBy("part").count().collect():
        asking[r["part"]] = r["count"]
    row_blocks = F.lit([int(-(-n // BLOCK_ROWS)) or 1 for n in sizes])[F.col("part")].cast("bigint")
    query_blocks = F.lit([int(-(-n // BLOCK_QUERIES)) or 1 for n in asking])[F.col("part")].cast("bigint")
    zero = F.lit(0).cast("bigint")
    right = indexed.withColumn("i", F.pmod(F.xxhash64("vec_id"), row_blocks)).select(
        "part", "i", F.explode(F.sequence(zero, query_blocks - 1)).alias("j"), "vec_id", "v"
    )
    left = routed.withColumn("j", F.pmod(F.xxhash64("query_id"), query_blocks)).select(
        "part", F.explode(F.sequence(zero, row_blocks - 1)).alias("i"), "j", "query_id", "q"
    )
    found = left.groupBy("part", "i", "j").cogroup(right.groupBy("part", "i", "j")).applyInArrow(
        partial(_compare, k=k), "query_id bigint, vec_id bigint, score double"
    )
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
