"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a random but repeatable order, are cut into blocks.  With T
slots in all, block i of a source that has n blocks may not run before slot
floor((i - 1) * T / n) and must have run by slot ceil(i * T / n).  Earliest deadline first
over the released blocks meets every deadline, so after any number of slots each source is
less than one block away from its share.

The schedule's size is bounded whatever the data: blocks grow so that there are at most
``MAX_SLOTS`` of them (and one more per source).
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basinlens.llm.common import sized, written

MAX_SLOTS = 100_000
MAX_SOURCES = 10_000  # sources with a share of their own; all others form one pool
POOL = "pool"


def pfair_order(blocks: list[int]) -> np.ndarray:
    """The source of each slot, for sources with these numbers of blocks."""
    slots = sum(blocks)
    done = [0] * len(blocks)
    waiting = [(0, s) for s, n in enumerate(blocks) if n]  # (release, source)
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    order = np.empty(slots, dtype=np.int64)
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[s] + 1) * slots // blocks[s]), s))
        _, s = heapq.heappop(ready)
        order[slot] = s
        done[s] += 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, (done[s] * slots // blocks[s], s))
    return order


def lengths(counts: list[int], weights: list[float], max_passes: float | None) -> list[int]:
    """Rows each source gives: the shortest mixture in which every document appears, at the target weights.

    With ``max_passes``, a source that would have to be repeated more often gives that much.
    """
    total = sum(weights)
    rows = max(n * total / w for n, w in zip(counts, weights, strict=True))
    most = float("inf") if max_passes is None else max_passes
    return [max(n, round(min(rows * w / total, most * n))) for n, w in zip(counts, weights, strict=True)]


def _groups(docs: DataFrame, source: str, weights: Mapping[str | None, float] | None, power: float) -> list[tuple[str, int, float]]:
    """(group, documents, weight); at most MAX_SOURCES and the pool come to the driver."""
    named = F.when(F.col(source).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    counts = docs.groupBy(named.alias("group")).agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "sources")
    every = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if weights is None:
        top = [(r["group"], r["n"], float(r["n"]) ** power) for r in counts.orderBy(F.desc("n"), "group").limit(MAX_SOURCES).collect()]
    else:
        wanted = {"null" if k is None else f"={k}": float(w) for k, w in weights.items() if w > 0}
        if len(wanted) > MAX_SOURCES:
            raise ValueError(f"weights for more than {MAX_SOURCES} sources")
        top = [(r["group"], r["n"], wanted[r["group"]]) for r in counts.where(F.col("group").isin(*wanted)).orderBy("group").collect()]
    rest = every - sum(n for _, n, _ in top)
    if rest:  # at its natural share
        named_weight = sum(w for *_, w in top)
        top.append((POOL, rest, named_weight * rest / (every - rest) if named_weight else 1.0))
    return top


def shares(
    docs: DataFrame,
    source: str = "source",
    weights: Mapping[str | None, float] | None = None,
    power: float = 0.75,
    max_passes: float | None = None,
) -> DataFrame:
    """(source, pool, documents, rows, target, reached) of the mixture that ``mix`` makes: shares of its rows, by weight and in fact."""
    groups = _groups(docs, source, weights, power)
    rows = lengths([n for _, n, _ in groups], [w for *_, w in groups], max_passes) if groups else []
    total = sum(w for *_, w in groups)
    out = [
        (g[1:] if g.startswith("=") else None, g == POOL, n, r, w / total, r / sum(rows)) for (g, n, w), r in zip(groups, rows, strict=True)
    ]
    return docs.sparkSession.createDataFrame(out, "source string, pool boolean, documents bigint, rows bigint, target double, reached double")


def mix(
    docs: DataFrame,
    source: str = "source",
    weights: Mapping[str | None, float] | None = None,
    power: float = 0.75,
    max_passes: float | None = None,
    block_rows: int = 64,
    ordered: bool = False,
) -> DataFrame:
    """``docs``, all columns, with ``pass_no``, ``block``, ``slot`` and ``position`` in the mixture.

    ``weights`` maps sources to target weights; sources without one form a pool at its
    natural share.  By default a source with n documents weighs ``n ** power``, which
    brings small sources up.  Every document appears at least once; sources below their
    weight start over (``pass_no`` from 0) as often as their weight asks; ``max_passes``
    bounds that, and such sources miss their weight (see ``shares``).  Position numbers the
    mixture from 0 without gaps; ``ordered`` also writes it in that order.

    A null source is a source of its own; repeated rows are documents like others; an
    empty table gives an empty result.  Columns of ``docs`` named like the new ones are
    replaced.

    Only hashes are sorted to number the documents of a source; where a block begins is a
    hash then, so a document finds its blocks by itself, in a search among at most
    ``MAX_SLOTS`` bounds, and whole documents move once, to their places in the mixture.
    Rows that are equal in all columns lie in one block.
    """
    added = ["pass_no", "block", "slot", "position"]
    docs = docs.drop(*added)
    spark = docs.sparkSession
    groups = _groups(docs, source, weights, power)
    named = F.when(F.col(source).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    if not groups:
        return docs.select("*", *(F.lit(0).cast("bigint").alias(c) for c in added))
    rows = lengths([n for _, n, _ in groups], [w for *_, w in groups], max_passes)
    size = max(block_rows, -(-sum(rows) // MAX_SLOTS))
    order = pfair_order([-(-r // size) for r in rows])
    ids = F.broadcast(spark.createDataFrame(pd.DataFrame({"_group": [g for g, *_ in groups], "_g": range(len(groups))})))
    pool = next((i for i, g in enumerate(groups) if g[0] == POOL), None)
    placed = docs.withColumn("_group", named).join(ids, "_group", "left").withColumn("_g", F.coalesce("_g", F.lit(pool).cast("bigint"))).drop("_group")
    hashed = placed.withColumn("_h", F.xxhash64(*[F.col(c) for c in docs.columns]))

    schedule = Schedule([n for _, n, _ in groups], rows, size, order)
    schedule.bound(_hashes_at(hashed.select("_g", "_h"), schedule.ranks()))
    shared = spark.sparkContext.broadcast(schedule)

    @F.pandas_udf("array<struct<pass_no: bigint, block: bigint, slot: bigint>>")
    def places(g: pd.Series, h: pd.Series) -> pd.Series:
        return shared.value.places(g.to_numpy(), h.to_numpy())

    out = hashed.withColumn("_places", places("_g", "_h")).select(*docs.columns, "_h", F.inline_outer("_places"))  # never empty; an inner one would place rows twice, to filter them
    if ordered:
        out = out.repartitionByRange("slot")
    base = F.broadcast(spark.createDataFrame(pd.DataFrame({"slot": np.arange(len(order)), "_base": schedule.bases()})))  # a row per slot
    within = W.partitionBy("slot").orderBy("pass_no", "_h")
    numbered = out.withColumn("_at", F.row_number().over(within)).join(base, "slot")
    return numbered.select(*docs.columns, "pass_no", "block", "slot", (F.col("_base") + F.col("_at") - 1).alias("position"))


class Schedule:
    """Where the blocks of each source begin, and the slots in which they run."""

    def __init__(self, counts: list[int], rows: list[int], size: int, order: np.ndarray):
        self.counts, self.rows, self.size, self.order = counts, rows, size, order
        self.starts = [np.append(np.arange(0, r, size), r) for r in rows]  # of blocks, in rows of the source's passes; and the end
        by_source = np.argsort(order, kind="stable")
        self.slots = np.split(by_source, np.cumsum([len(s) - 1 for s in self.starts])[:-1])  # of each source's blocks

    def ranks(self) -> pd.DataFrame:
        """The ranks, within their source, of the documents with which blocks begin (or the last pass ends)."""
        parts = [pd.DataFrame({"_g": g, "_k": np.unique(s % n)}) for g, (s, n) in enumerate(zip(self.starts, self.counts, strict=True))]
        return pd.concat(parts, ignore_index=True)

    def bound(self, hashes: pd.DataFrame) -> None:
        """Take the hashes (_g, _k, _h) of those documents and how many of the source come before (_first: equal hashes go together)."""
        known = {g: part for g, part in hashes.groupby("_g")}
        self.bounds: list[dict[int, tuple[int, np.ndarray]]] = []  # by source and pass: blocks begun before the pass, hashes where blocks begin
        self.passes: list[tuple[int, int | None]] = []  # whole passes, and the hash at which the last one ends
        for g, n in enumerate(self.counts):
            part = known[g].set_index("_k")
            number, rank = np.divmod(self.starts[g], n)
            h, first = part["_h"].reindex(rank).to_numpy(np.int64), part["_first"].reindex(rank).to_numpy(np.int64)
            self.starts[g] = number * n + first
            h = np.where(first == 0, np.iinfo(np.int64).min, h)
            end = int(number[-1]), (int(h[-1]) if first[-1] else None)
            number, h = number[:-1], h[:-1]
            cuts = np.searchsorted(number, np.arange(end[0] + 2))
            self.bounds.append({p: (int(cuts[p]), h[cuts[p] : cuts[p + 1]]) for p in range(end[0] + 1)})
            self.passes.append(end)

    def bases(self) -> np.ndarray:
        """The first position of each slot."""
        held = np.empty(len(self.order), dtype=np.int64)
        for slots, starts in zip(self.slots, self.starts, strict=True):
            held[slots] = np.diff(starts)
        return np.cumsum(held) - held

    def places(self, g: np.ndarray, h: np.ndarray) -> pd.Series:
        """For each document: the passes in which it appears, with block and slot."""
        out = np.empty(len(g), dtype=object)
        for source in np.unique(g).tolist():
            at = np.flatnonzero(g == source)
            whole, last = self.passes[source]
            lists: list[list[dict]] = [[] for _ in at]
            for number, (before, bounds) in self.bounds[source].items():
                some = np.arange(len(at)) if number < whole else np.flatnonzero(h[at] < last) if last is not None else at[:0]
                blocks = before + np.searchsorted(bounds, h[at[some]], side="right") - 1
                for i, block, slot in zip(some.tolist(), blocks.tolist(), self.slots[source][blocks].tolist(), strict=True):
                    lists[i].append({"pass_no": number, "block": block, "slot": slot})
            for i, found in zip(at.tolist(), lists, strict=True):
                out[i] = found
        return pd.Series(out)


def _hashes_at(hashes: DataFrame, ranks: pd.DataFrame) -> pd.DataFrame:
    """(_g, _k, _h, _first) of the given ranks within sources: at most one for each block and source.

    Hashes are sorted in ranges and written; a hash's rank is its place in its range plus
    the sizes of the ranges before, so a source with a third of all rows lies in as many
    ranges as others.
    """
    spark = hashes.sparkSession
    dealt = hashes.repartitionByRange("_g", "_h").sortWithinPartitions("_g", "_h").withColumn("_mid", F.monotonically_increasing_id())
    dealt = written(dealt, "dealt").withColumn("_part", F.shiftright("_mid", 33))
    sizes = dealt.groupBy("_g", "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_start"))
    before = W.partitionBy("_g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_g", "_part", "_start", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    offsets = written(offsets, "offsets")  # one row per range and source within it
    number = (F.col("_before") + F.col("_mid") - F.col("_start")).alias("_k")
    numbered = dealt.join(sized(offsets), ["_g", "_part"]).select("_g", "_h", number)
    wanted = numbered.join(F.broadcast(spark.createDataFrame(ranks)), ["_g", "_k"])
    wanted = written(wanted, "bounds")
    firsts = numbered.join(F.broadcast(wanted.select("_g", "_h").distinct()), ["_g", "_h"], "left_semi").groupBy("_g", "_h").agg(F.min("_k").alias("_first"))
    return wanted.join(firsts, ["_g", "_h"]).toPandas()
