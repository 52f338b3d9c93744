"""Helpers shared by the text operators: reading, written tables, sized joins, streamed groups, components."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinlens.session import checkpoint_dir

FEW_LINKS = 300_000  # links (two ids each) that one task joins
BROADCAST_ROWS = 500_000  # narrow rows (ids, counts, hashes) that a broadcast side may hold


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/basinlens-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later passes read, not recompute, it.

    A lost executor takes nothing with it, and rows that depend on how a shuffle
    arrived are fixed once.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` (a written table) has no more than ``rows`` rows."""
    return df.count() <= rows


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a written, narrow side: broadcast up to ``limit`` rows, sort-merge beyond it."""
    return df.hint("broadcast" if at_most(df, limit) else "merge")


def sampled(df: DataFrame, most: int, keys: Sequence[str]) -> DataFrame:
    """All rows of ``df`` (a written table) if there are at most ``most``, else about so many, by the hash of ``keys``.

    Rows whose hash lies in a share of the range: a task hands on its share, not its own
    best ``most``.  The limit only counts where very many rows have equal keys.
    """
    rows = df.count()
    if rows <= most:
        return df
    return df.where(F.xxhash64(*keys) < F.lit(int(most / rows * 2**64) - 2**63)).limit(2 * most)


def total(df: DataFrame, value: Column) -> int:
    return int(df.agg(F.coalesce(F.sum(value), F.lit(0)).alias("v")).first()["v"])


def stream_groups(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str]
) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal ``keys`` (integers, rows sorted by them), one group in memory at a time."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(int(c[a]) for c in columns)
            if key != current:
                if held:
                    yield current, pa.Table.from_batches(held)
                held, current = [], key
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def binary_rows(array: pa.Array) -> list[memoryview]:
    """The values of a binary array without copying them one by one."""
    if isinstance(array, pa.ChunkedArray):
        return [v for chunk in array.chunks for v in binary_rows(chunk)]
    width = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    ends = np.frombuffer(array.buffers()[1], dtype=width)[array.offset : array.offset + len(array) + 1]
    data = memoryview(array.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for at in range(0, len(nodes), 10_000):
        some = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["node", "label"])


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node that links reach.

    Few links, at most ``FEW_LINKS`` (a fixed size, not a share), are joined by union-find
    in one task.  More of them alternate large-star and small-star (Kiveris et al., 2014):
    they shrink to stars around the smallest nodes in a logarithmic number of rounds.
    Minima are taken by partial aggregation and written, so both sides of each join are
    plain shuffles of written rows, where AQE splits a node that holds very many links.
    """
    links = written(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), f"{name}-links")
    if at_most(links, FEW_LINKS):
        return written(links.repartition(1).mapInArrow(_union_find, "node bigint, label bigint"), f"{name}-labels")
    before = None
    while True:
        both = links.unionByName(links.selectExpr("b AS a", "a AS b"))
        low = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")), f"{name}-low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(large.where("a <> b").distinct(), f"{name}-large")
        least = written(large.groupBy("a").agg(F.min("b").alias("low")), f"{name}-least")
        small = large.join(least, "a").select("b", "low").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = written(small.unionByName(least.selectExpr("a", "low AS b")).distinct(), f"{name}-links")
        # sums over the links do not change once every link is (node, smallest node)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
        before = now


def per_process(key: str, build: Callable[[], object]) -> object:
    """``build()``, once per Python worker process: functions that travel by value lose their globals between tasks.

    Only the latest key is kept, so one operator's tables do not stay beside the next one's.
    """
    kept = sys.modules.setdefault("_basinlens_process", types.ModuleType("_basinlens_process"))
    if getattr(kept, "key", None) != key:
        kept.key, kept.value = key, None
        pa.default_memory_pool().release_unused()
        kept.value = build()
    return kept.value


def forget_process() -> None:
    """Let go of what an earlier operator left in this worker process."""
    per_process("", lambda: None)
