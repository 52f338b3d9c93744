"""N-gram Jaccard self-join by prefix trees.

Each document is the set of its word n-grams (64-bit hashes).  In any global order of
n-grams, two sets of similarity t share one of their first ``n - ceil(t * n) + 1`` ones.
The order taken is: by the number of sets that hold an n-gram, rare ones first, with the
few that a fixed share of all sets hold ("common") at the end.  An n-gram that one set
alone holds can link nothing, so

1. sets are dealt by n-gram range as packed arrays, and each range counts in how many
   sets an n-gram occurs (over all documents).  Common n-grams are not dealt: where a
   set's other n-grams fill its prefix they play no part, else their place in it is known;
2. a set whose own n-grams fill its prefix is done; of the others ("active" sets) the
   shared n-grams within the prefix are kept, as postings;
3. active sets meet in groups of one n-gram.  In a group they are stored, ordered by hash,
   in a prefix tree (trie); a set walks the tree once, branches that start alike share
   their overlap, and a branch is left when the set sizes and what remains of both sides
   cannot reach the threshold any more;
4. a first round groups by the smallest hash, which links most near copies; the second
   round, which makes the result complete, takes every posting whose sets are not in one
   component yet.

Results are exact up to collisions of 64-bit hashes of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinlens.llm.common import binary_rows, connected_components, forget_process, sized, stream_groups, total, written

TOKENS_PER_RANGE = 2_000_000  # n-grams that one counting group holds, about 130 MB while sorted
TOKENS_PER_CELL = 1_000_000  # n-grams that one trie holds; larger groups are cut into cells
TOKENS_PER_CLUSTER = 300_000  # up to this size, all sets that postings connect meet once, in one trie
FLUSH = 1_000_000  # n-grams a task packs before it hands them on
FLUSH_SETS = 65_000  # sets it packs at most: their numbers take 16 bits
COPIED_SETS = 2_000_000  # up to so many sets of several rows are known to every task, 16 bytes each
COMMON_SHARE = 256  # an n-gram is common if one in so many sets holds it

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def ngram_set(text: memoryview | bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word n-grams of a UTF-8 text.

    A-Z are lower-cased; words are runs of anything but ASCII white space.  A shorter
    text gives its whole word sequence as one n-gram; no words give the empty set.
    """
    words = bytes(text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    count = len(words) - width + 1
    with np.errstate(over="ignore"):
        sums = np.full(count, width, dtype=np.uint64)
        for i in range(width):
            sums = _mixed(sums + hashes[i : i + count])
    return np.unique(sums)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    both = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def _frequent(sets: list[np.ndarray]) -> bytes:
    """(n-gram, sets) pairs of those that many of a task's sets hold; what all sets often hold, some task often holds."""
    tokens, holders = np.unique(np.concatenate(sets), return_counts=True)
    mask = holders >= max(4, len(sets) // (2 * COMMON_SHARE))
    return np.stack([tokens[mask].view(np.int64), holders[mask]], axis=1).astype(np.int64).tobytes()


def _describe(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    forget_process()
    held: list[np.ndarray] = []
    weight = 0
    last = None

    def row(blobs: list[bytes | None], *columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary())], ["doc_id", "n", "d1", "d2", "frequent"])

    for batch in batches:
        sizes, first, second = [], [], []
        for text in binary_rows(batch.column("text")):
            tokens = ngram_set(text, size)
            d1, d2 = _digest(tokens)
            sizes.append(len(tokens))
            first.append(d1)
            second.append(d2)
            held.append(tokens)
        weight += sum(sizes)
        blobs: list[bytes | None] = [None] * len(sizes)
        if weight >= FLUSH:
            blobs[-1] = _frequent(held)
            held, weight = [], 0
        yield row(blobs, batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()))
        last = batch
    if last is not None and weight:  # a row of its own, marked by n = -1
        none = pa.array([None], pa.int64())
        yield row([_frequent(held)], none, pa.array([-1], pa.int64()), none, none)


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in binary_rows(batch.column("frequent")):
            pairs = np.frombuffer(blob, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["token", "holders"])


def common_ngrams(described: DataFrame) -> np.ndarray:
    """N-grams that at least one in COMMON_SHARE sets holds: at most COMMON_SHARE times the mean set size."""
    tallies = described.where("frequent is not null").select("frequent").mapInArrow(_unfold, "token bigint, holders bigint")
    floor = max(64, described.where("n > 0").count() // COMMON_SHARE)
    rows = tallies.groupBy("token").agg(F.sum("holders").alias("holders")).where(F.col("holders") >= floor).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy().astype(np.int64).view(np.uint64))


def copied_sets(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, of the sets that rows of several ids have, and the row to count; none of more than COPIED_SETS.

    It only saves work: where a task knows nothing of copies elsewhere, they are dealt as well.
    """
    several = classes.where("rep < last").select("d1", "rep").limit(COPIED_SETS + 1).toArrow()
    if several.num_rows > COPIED_SETS:
        several = several.slice(0, 0)
    several = several.combine_chunks().sort_by("d1")
    return several["d1"].to_numpy(), several["rep"].to_numpy()


def _steps(owners: np.ndarray) -> bytes:
    """Ascending 16-bit numbers as differences, low bytes first, then high ones: runs that a shuffle's compression shrinks."""
    steps = np.diff(owners, prepend=0).astype("<u2")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 2).T).tobytes()


def _from_steps(data: memoryview) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, -1).T).view("<u2").ravel()
    return np.cumsum(steps, dtype=np.int64)


def _slices(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _part(tokens: np.ndarray, ranges: int) -> np.ndarray:
    return (((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


SENT = "flush bigint, part int, keys binary, slacks binary, owners binary, tokens binary"


def _sent(flush: int, part: Sequence[int], **columns: list[bytes]) -> pa.RecordBatch:
    n = len(part)
    names = ("keys", "slacks", "owners", "tokens", *(["holders"] if "holders" in columns else []))
    blobs = [pa.array(columns.get(c, [None] * n), pa.binary()) for c in names]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, flush, np.int64)), pa.array(part, pa.int32()), *blobs], ["flush", "part", *names])


def _deal(batches: Iterator[pa.RecordBatch], size: int, ranges: int, common, copies, top: int, bottom: int) -> Iterator[pa.RecordBatch]:
    """Pack n-grams by hash range: (flush, part, owners, low halves of the hashes).

    A flush is some sets of one task, numbered by key; its n-grams name their set by that
    number, so that no key travels with every n-gram.  Keys and slacks go once, under a
    negative part.  A set's slack is the number of its n-grams that are not common less its
    prefix length; where it is negative, the prefix ends within the common n-grams, which
    are handed on, whole hashes with whole keys, under a negative part too.
    """
    forget_process()
    often, (copied, reps) = common.value, copies.value
    held: dict[int, tuple[int, np.ndarray]] = {}  # key: slack, n-grams that are not common
    direct: list[tuple[int, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held and not direct:
            return
        keys = np.array(sorted(held), dtype=np.int64)
        # named by what it holds: should a task run again with its rows in another order, nothing is mixed up
        name = int.from_bytes(xxhash.xxh3_64_digest(keys.tobytes()), "little", signed=True)
        aside = -1 - name % ranges
        if len(keys):
            sets = [held[k][1] for k in keys.tolist()]
            tokens = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            part = _part(tokens, ranges)
            order = np.argsort(part, kind="stable")
            part, owner, tokens = part[order], owner[order], (tokens[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            bounds = np.searchsorted(part, np.arange(ranges + 1))
            filled = np.flatnonzero(np.diff(bounds))
            bounds = np.append(bounds[filled], len(tokens))
            owners = [_steps(owner[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield _sent(name, filled, owners=owners, tokens=_slices(tokens, bounds))
            slacks = np.array([held[k][0] for k in keys.tolist()], dtype=np.int32)
            yield _sent(name, [aside], keys=[keys.tobytes()], slacks=[slacks.tobytes()])
        if direct:
            whole = np.repeat(np.array([k for k, _ in direct], dtype=np.int64), [len(t) for _, t in direct])
            yield _sent(name, [aside], keys=[whole.tobytes()], tokens=[np.concatenate([t for _, t in direct]).tobytes()])
        held.clear()
        direct.clear()

    weight, seen = 0, set()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), binary_rows(batch.column("text")), strict=True):
            tokens = ngram_set(text, size)
            key = _digest(tokens)[0]
            if not len(tokens) or key in seen:  # one copy is enough: sets are counted, not rows
                continue
            at = np.searchsorted(copied, key)
            if at < len(copied) and copied[at] == key and reps[at] != doc_id:
                continue
            seen.add(key)
            prefix = len(tokens) - (len(tokens) * top + bottom - 1) // bottom + 1
            if len(often):
                place = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                is_common = often[place] == tokens
                shared = tokens[is_common]
                tokens = tokens[~is_common]
                if len(tokens) < prefix:
                    direct.append((key, shared[: prefix - len(tokens)]))
            if len(tokens):
                held[key] = len(tokens) - prefix, tokens
            weight += len(tokens) + 1
            if weight >= FLUSH or len(held) >= FLUSH_SETS:
                yield from flush()
                weight, seen = 0, set()
    yield from flush()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each hash range: the n-grams that at least two sets hold, with their counts.

    A copy that two flushes hold counts twice: that only keeps n-grams which link nothing.
    """
    for (part,), table in stream_groups(batches, ["part"]):
        flushes = table.column("flush").to_pylist()
        rows = {c: binary_rows(table.column(c)) for c in ("owners", "tokens")} if part >= 0 else {}
        if part < 0:
            table = table.append_column("holders", pa.nulls(table.num_rows, pa.binary()))
            yield from table.combine_chunks().to_batches()
            continue
        blobs = [np.frombuffer(v, dtype=np.uint32) for v in rows["tokens"]]
        tokens = np.concatenate(blobs)
        _, inverse, holders = np.unique(tokens, return_inverse=True, return_counts=True)
        holders = np.minimum(holders[inverse], 65535).astype(np.uint16)
        at = 0
        for flush, owners, own in zip(flushes, rows["owners"], blobs, strict=True):
            among = holders[at : at + len(own)]
            at += len(own)
            mask = among >= 2
            if mask.any():
                yield _sent(flush, [part], owners=[_steps(_from_steps(owners)[mask])], tokens=[own[mask].tobytes()], holders=[among[mask].tobytes()])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per active set: the n-grams within its prefix that other sets hold too."""
    for _, table in stream_groups(batches, ["flush"]):
        keys = None
        for row in table.filter(pa.compute.less(table.column("part"), 0)).to_pylist():
            own = np.frombuffer(row["keys"], np.int64)
            if row["slacks"] is not None:
                keys, slacks = own, np.frombuffer(row["slacks"], np.int32)
            else:
                tokens = np.frombuffer(row["tokens"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(own)], ["token", "key"])
        table = table.filter(pa.compute.greater_equal(table.column("part"), 0))
        if not table.num_rows:
            continue
        if keys is None:
            raise RuntimeError("the keys of some n-grams are missing: a lost task read its rows in another order; write the input first")
        parts = table.column("part").to_pylist()
        blobs = [np.frombuffer(v, np.uint32) for v in binary_rows(table.column("tokens"))]
        owner = np.concatenate([_from_steps(v) for v in binary_rows(table.column("owners"))])
        holders = np.concatenate([np.frombuffer(v, np.uint16) for v in binary_rows(table.column("holders"))])
        full = np.concatenate([(p << 32) | b.astype(np.int64) for p, b in zip(parts, blobs, strict=True)])
        # prefix length, less the n-grams that no other set holds
        room = np.bincount(owner, minlength=len(keys)) - slacks.astype(np.int64)
        mask = room[owner] > 0
        owner, full, holders = owner[mask], full[mask], holders[mask]
        order = np.lexsort((full, holders, owner))
        owner, full = owner[order], full[order]
        keep = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(keys)))[owner] < room[owner]
        yield pa.RecordBatch.from_arrays([pa.array(full[keep]), pa.array(keys[owner[keep]])], ["token", "key"])


class Trie:
    """Sets in one global order; branches that start alike share their nodes."""

    __slots__ = ("branches", "low", "high", "mark", "whole", "ends", "run", "depth")

    def __init__(self, run: np.ndarray, depth: int, low: int, high: int, mark: int):
        self.run, self.depth = run, depth  # the node's n-grams; n-grams down to its end
        self.low, self.high = low, high  # set sizes below
        self.mark, self.whole = mark, True  # one member; all members were in its component
        self.branches: dict[int, Trie] = {}
        self.ends: list[int] = []

    def add(self, tokens: np.ndarray, member: int, forest: Forest) -> None:
        node, at, size = self, 0, len(tokens)
        while True:
            node.low, node.high = min(node.low, size), max(node.high, size)
            node.whole = node.whole and forest.root(node.mark) == forest.root(member)
            if at == size:
                node.ends.append(member)
                return
            head = int(tokens[at])
            child = node.branches.get(head)
            if child is None:
                leaf = Trie(tokens[at:], size, size, size, member)
                leaf.ends.append(member)
                node.branches[head] = leaf
                return
            width = min(len(child.run), size - at)
            differ = np.flatnonzero(child.run[:width] != tokens[at : at + width])
            same = int(differ[0]) if len(differ) else width
            if same < len(child.run):  # split the child where the two part
                upper = Trie(child.run[:same], child.depth - len(child.run) + same, child.low, child.high, child.mark)
                upper.whole = child.whole
                upper.branches[int(child.run[same])] = child
                child.run = child.run[same:]
                node.branches[head] = child = upper
            node, at = child, at + same

    def link(self, tokens: np.ndarray, member: int, forest: Forest, top: int, bottom: int) -> None:
        """Join ``member`` with every set of similarity >= top / bottom that it is not joined with yet."""
        size = len(tokens)
        both = top + bottom
        stack = [(self, 0, 0)]
        while stack:
            node, at, overlap = stack.pop()
            if node.high * bottom < size * top or node.low * top > size * bottom:
                continue
            if node.whole and forest.root(node.mark) == forest.root(member):
                continue
            run = node.run
            if len(run):
                until = at + int(np.searchsorted(tokens[at:], run[-1], side="right"))
                if until > at:
                    place = np.searchsorted(run, tokens[at:until])
                    overlap += int(np.count_nonzero(run[place] == tokens[at:until]))
                at = until
            # overlap o of sizes n, m reaches t = top/bottom when (top + bottom) * o >= top * (n + m)
            if both * (overlap + min(size - at, node.high - node.depth)) < top * (size + node.low):
                continue
            if node.ends and both * overlap >= top * (size + node.depth):
                forest.join(node.ends[0], member)
                for other in node.ends[1:]:
                    forest.join(other, member)
            stack.extend((child, at, overlap) for child in node.branches.values())


class Forest:
    """Union-find over the members of one group."""

    def __init__(self, parents: list[int]):
        self.parent = parents
        self.made: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.made.append((x, y))


def link_sets(sets: list[np.ndarray], labels: list[int], top: int, bottom: int) -> list[tuple[int, int]]:
    """Positions of linked pairs that, with equal labels, connect what similarity >= top / bottom connects."""
    first: dict[int, int] = {}
    forest = Forest([first.setdefault(label, i) for i, label in enumerate(labels)])
    trie = Trie(np.empty(0, np.uint64), 0, 1 << 62, 0, 0)
    for i, tokens in enumerate(sets):
        if i:
            trie.link(tokens, i, forest, top, bottom)
        trie.add(tokens, i, forest)
    return forest.made


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Of (rep, d1, d2, text): the set of each text that has this digest."""
    for batch in batches:
        reps, firsts, lows, blobs = [], [], [], []
        known = zip(batch.column("rep").to_pylist(), batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), strict=True)
        for (rep, d1, d2), text in zip(known, binary_rows(batch.column("text")), strict=True):
            tokens = ngram_set(text, size)
            if len(tokens) and _digest(tokens) == (d1, d2):
                reps.append(rep)
                firsts.append(d1)
                lows.append(int(tokens[:1].view(np.int64)[0]))
                blobs.append(tokens.tobytes())
        columns = [pa.array(reps, pa.int64()), pa.array(firsts, pa.int64()), pa.array(lows, pa.int64()), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["rep", "d1", "low", "tokens"])


def _link_groups(batches: Iterator[pa.RecordBatch], keys: list[str], top: int, bottom: int) -> Iterator[pa.RecordBatch]:
    for _, table in stream_groups(batches, keys):
        reps = table.column("rep").to_pylist()
        labels = table.column("label").to_pylist()
        if len(set(reps)) < 2:
            continue
        sets = [np.frombuffer(v, dtype=np.uint64) for v in binary_rows(table.column("tokens"))]
        pairs = link_sets(sets, labels, top, bottom)
        if pairs:
            a, b = (pa.array([reps[p[i]] for p in pairs], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])


def _linked(rows: DataFrame, keys: list[str], top: int, bottom: int) -> DataFrame:
    """Links within the groups of ``keys``; rows (keys..., rep, label, tokens)."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "label", "rep")
    return dealt.mapInArrow(partial(_link_groups, keys=keys, top=top, bottom=bottom), "a bigint, b bigint")


def _first_round(sets: DataFrame, top: int, bottom: int) -> DataFrame:
    """Groups of equal smallest hash; a large group is cut into cells that all hold its first set."""
    groups = sets.groupBy("low").agg(
        F.count(F.lit(1)).alias("members"), F.sum(F.length("tokens") / 8).alias("weight"), F.min("rep").alias("head")
    )
    groups = written(groups.where("members > 1").withColumn("cells", F.ceil(F.col("weight") / TOKENS_PER_CELL)), "lows")
    own = F.pmod(F.xxhash64("rep"), F.col("cells"))
    cells = F.when(F.col("rep") == F.col("head"), F.sequence(F.lit(0).cast("bigint"), F.col("cells") - 1)).otherwise(F.array(own))
    rows = sets.join(sized(groups), "low").select("low", F.explode(cells).alias("cell"), "rep", F.col("rep").alias("label"), "tokens")
    return _linked(rows, ["low", "cell"], top, bottom)


def _second_round(sets: DataFrame, postings: DataFrame, labels: DataFrame, top: int, bottom: int) -> DataFrame:
    """Every posting whose sets lie in several components.

    Near copies share many n-grams and so many groups: sets that such groups connect meet
    once, as a cluster, where that is small enough, and else group by group.  A group larger than one cell is cut: sets of its largest component meet only sets of
    other components, and those meet one another cell by cell, so no pair is left out.
    """
    known = sets.select("rep", "d1", (F.length("tokens") / 8).cast("bigint").alias("n")).join(sized(labels.withColumnRenamed("node", "rep")), "rep", "left")
    known = written(known.select("rep", "d1", "n", F.coalesce("label", "rep").alias("label")), "labelled")
    rows = written(postings.join(sized(known.withColumnRenamed("d1", "key")), "key").select("token", "rep", "n", "label"), "postings")
    mixed = F.col("label").cast("string")
    groups = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("n").alias("weight"),
        F.min("label").alias("low_label"),
        F.max("label").alias("high_label"),
        F.min("rep").alias("low"),
        F.max("rep").alias("high"),
        # two 64-bit sums of hashes tell lists of members apart
        F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum1"),
        F.sum(F.xxhash64(mixed, F.col("rep")).cast("decimal(38,0)")).alias("sum2"),
    )
    groups = groups.where("low_label < high_label")
    # n-grams with the same sets need one meeting
    lists = groups.groupBy("members", "weight", "low", "high", "sum1", "sum2").agg(F.min("token").alias("token"))
    lists = written(lists.select("token", "low", F.ceil(F.col("weight") / TOKENS_PER_CELL).alias("cells")), "lists")
    members = written(rows.join(sized(lists), "token").select("token", "low", "cells", "rep", "n", "label"), "members")
    clusters = connected_components(members.select(F.col("rep").alias("a"), F.col("low").alias("b")), "clusters")
    clusters = written(known.join(sized(clusters.selectExpr("node AS rep", "label AS cluster")), "rep").select("cluster", "rep", "n", "label"), "clusters")
    weights = clusters.groupBy("cluster").agg(F.sum("n").alias("n"))
    heavy = written(weights.where(F.col("n") > TOKENS_PER_CLUSTER).select("cluster"), "heavy-clusters")
    light = clusters.join(sized(heavy), "cluster", "left_anti").selectExpr(
        "cluster AS token", "0L AS i", "-1L AS j", "rep", "label"
    )
    in_heavy = written(clusters.join(sized(heavy), "cluster").select("rep"), "heavy-sets")
    members = members.join(sized(in_heavy), "rep", "left_semi")
    plain = members.where("cells = 1").select("token", F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j"), "rep", "label")
    large = members.where("cells > 1")
    shares = large.groupBy("token", "label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    main = shares.groupBy("token").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("other")
    )
    main = written(main.withColumn("others", F.greatest(F.lit(1), F.ceil(F.col("other") / TOKENS_PER_CELL))), "mains")
    split = large.join(sized(main), "token")
    in_main = F.col("label") == F.col("main")
    own_main, own_other = F.pmod(F.xxhash64("rep"), F.col("cells")), F.pmod(F.xxhash64("rep"), F.col("others"))
    zero = F.lit(0).cast("bigint")
    others, mains = F.sequence(zero, F.col("others") - 1), F.sequence(zero, F.col("cells") - 1)
    # cells (i >= 0, j): piece i of the main component with piece j of the rest; (-1 - i, j): two pieces of the rest
    with_rest = F.transform(others, lambda j: F.struct(own_main.alias("i"), j.alias("j")))
    with_main = F.transform(mains, lambda i: F.struct(i.alias("i"), own_other.alias("j")))
    among = F.transform(
        others, lambda k: F.struct((F.lit(-1) - F.greatest(k, own_other)).alias("i"), F.least(k, own_other).alias("j"))
    )
    cells = F.when(in_main, with_rest).otherwise(F.concat(with_main, among))
    cut = split.select("token", "rep", "label", F.explode(cells).alias("cell")).select("token", "cell.i", "cell.j", "rep", "label")
    placed = written(light.unionByName(plain).unionByName(cut), "placed")
    side = sets.select("rep", "tokens")
    dealt = placed.join(side, "rep").select("token", "i", "j", "rep", "label", "tokens")
    return _linked(dealt, ["token", "i", "j"], top, bottom)


def similar_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, top: int = 4, bottom: int = 5
) -> DataFrame:
    """(key, n_shingles, component_id) per row of ``docs``.

    Rows link when the Jaccard similarity of their ``size``-word n-gram sets is at least
    ``top / bottom``; ``component_id`` is the smallest key that links reach, the row's own
    included.  Null or wordless texts have an empty set and link with nothing.  A row with
    a null key keeps its size, has a null component and takes no part in links.  Repeated
    rows come back as often as they came; rows of one key and different texts are linked
    through that key.  An empty table gives an empty result; other columns are ignored.
    """
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    described = source.mapInArrow(
        partial(_describe, size=size), "doc_id bigint, n bigint, d1 bigint, d2 bigint, frequent binary"
    )
    described = written(described, "sets")
    common = source.sparkSession.sparkContext.broadcast(common_ngrams(described))
    described = described.where("n >= 0").drop("frequent")
    classes = described.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(
        F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")
    )
    classes = written(classes, "classes")

    ranges = max(16, -(-total(classes, F.col("n")) // TOKENS_PER_RANGE))
    copies = source.sparkSession.sparkContext.broadcast(copied_sets(classes))
    dealt = source.where("doc_id is not null").mapInArrow(
        partial(_deal, size=size, ranges=ranges, common=common, copies=copies, top=top, bottom=bottom), SENT
    )
    shared = dealt.repartition(ranges, "part").sortWithinPartitions("part").mapInArrow(_count, f"{SENT}, holders binary")
    postings = shared.repartition(ranges, "flush").sortWithinPartitions("flush").mapInArrow(_postings, "token bigint, key bigint")
    # a set that several tasks dealt may post a common n-gram more than once
    postings = written(postings.distinct(), "prefixes")

    active = postings.select(F.col("key").alias("d1")).distinct().join(classes, "d1").select("rep", "d1", "d2")
    active = written(active, "active")
    texts = source.join(sized(active), F.col("doc_id") == F.col("rep")).select("rep", "d1", "d2", "text")
    sets = texts.mapInArrow(partial(_sets, size=size), "rep bigint, d1 bigint, low bigint, tokens binary")
    sets = written(sets, "active-sets")

    first = written(_first_round(sets, top, bottom), "links")
    labels = connected_components(first, "first")
    second = _second_round(sets, postings, labels, top, bottom)
    # rows of one key with different texts are one document
    same = described.where("n > 0 and doc_id is not null").select("doc_id", "d1", "d2").distinct()
    same = same.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").join(described, "doc_id").where("n > 0")
    same = same.join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = written(first.unionByName(second).unionByName(same), "all-links")
    labels = connected_components(links, "all")

    # only classes of several rows, or with links, need a label other than their own id
    label = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "d1", "d2", F.coalesce("label", "rep").alias("component_id"), "rep", "last"
    )
    label = written(label.where("component_id <> rep or rep <> last").select("d1", "d2", "component_id"), "labels")
    out = described.join(sized(label), ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
