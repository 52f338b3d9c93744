"""Ranked lexical search for a set of queries, with shared sub-expressions computed once.

An item's score of a document is a sum over the item's terms, so sums over term sets that
several items share can be computed once per document.

1. **Mining.**  Terms that occur in the same items of a block form one set.  Over those
   sets, the largest intersection of two expressions becomes an expression of its own and
   replaces its parts wherever all of them stand; shared sets are themselves expressions,
   so they nest.  It ends when no two expressions share two parts: a query-sharing DAG.
2. **Documents.**  One pass splits every text, keeps its length and the counts of the
   terms that items ask for (a forward table), and yields the corpus statistics.
3. **Evaluation.**  Documents meet a block's DAG in batches: term by document values, then
   level by level the partial sums of the shared sets, each once, and last the items.
   A task keeps its best documents of each item; two windows take the best of all.

Queries come in portions of a bounded size, and each portion reads the forward table of
its own pass, so neither documents nor queries have to fit in memory.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinlens.llm.common import stream_groups, written

BLOCK_ITEMS = 256  # items whose shared sets are mined together
BLOCK_TERMS = 60_000  # term entries (item, term) of a block, on average at most
PORTION_BYTES = 32 << 20  # bytes of blocks that tasks hold at once
DOCUMENTS = 1024  # documents evaluated together
TOP = 10

#: Separators are ASCII characters other than letters and digits; a fixed value.
_KEPT = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b in _KEPT else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order: runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z are lowered."""
    return (text or "").encode().translate(_FOLD).split()


def share(members: list[set[int]]) -> tuple[list[list[int]], list[int]]:
    """The sharing DAG of sets of leaf numbers: (children of each inner node, level of each inner node).

    Leaves are numbered 0..n-1 (n: the greatest leaf, plus one), inner nodes from n on in
    the order of evaluation; the last ``len(members)`` nodes are the members themselves.
    Each node is the disjoint union of its children.
    """
    leaves = 1 + max((max(m) for m in members if m), default=-1)
    holders: dict[int, list[int]] = {}
    for at, member in enumerate(members):
        for leaf in member:
            holders.setdefault(leaf, []).append(at)
    classes: dict[tuple[int, ...], list[int]] = {}
    for leaf in sorted(holders):
        classes.setdefault(tuple(holders[leaf]), []).append(leaf)
    units: list[list[int]] = []  # parts that stand for themselves, as lists of nodes; columns of the matrix
    nodes: list[list[int]] = []  # children of shared nodes
    for leaf_set in classes.values():
        if len(leaf_set) > 1:
            nodes.append(leaf_set)
            units.append([leaves + len(nodes) - 1])
        else:
            units.append(leaf_set)
    width = len(units)
    names = [u[0] for u in units]
    rows = np.zeros((len(members), width), dtype=np.float32)
    for column, signature in enumerate(classes):
        rows[list(signature), column] = 1
    extra: list[int] = []  # rows beyond the members are shared nodes
    overlap = rows @ rows.T
    np.fill_diagonal(overlap, 0)
    while overlap.size:
        best = int(overlap.argmax())
        first, second = divmod(best, len(rows))
        if overlap[first, second] < 2:
            break
        common = rows[first] * rows[second]
        held = np.flatnonzero(rows @ common == common.sum())
        nodes.append([])
        names.append(leaves + len(nodes) - 1)
        extra.append(len(nodes) - 1)
        rows[held] -= common
        column = np.zeros((len(rows), 1), dtype=np.float32)
        column[held] = 1
        rows = np.hstack([rows, column])
        rows = np.vstack([rows, np.append(common, np.float32(0))])
        changed = np.append(held, len(rows) - 1)
        grown = np.zeros((len(rows), len(rows)), dtype=np.float32)
        grown[:-1, :-1] = overlap
        grown[changed] = rows[changed] @ rows.T
        grown[:, changed] = grown[changed].T
        np.fill_diagonal(grown, 0)
        overlap = grown
    for place, node in enumerate(extra):
        nodes[node] = [names[c] for c in np.flatnonzero(rows[len(members) + place])]
    finals = [[names[c] for c in np.flatnonzero(rows[at])] for at in range(len(members))]
    # order by level, so that all children come before their parents
    depth: dict[int, int] = {}

    def level(node: int) -> int:
        if node < leaves:
            return 0
        if node not in depth:
            depth[node] = 1 + max((level(c) for c in nodes[node - leaves]), default=0)
        return depth[node]

    order = sorted(range(len(nodes)), key=lambda i: level(leaves + i))
    renamed = {leaves + old: leaves + new for new, old in enumerate(order)}
    top = 1 + max((level(leaves + i) for i in order), default=0)
    children = [[renamed.get(c, c) for c in nodes[old]] for old in order] + [[renamed.get(c, c) for c in f] for f in finals]
    return children, [level(leaves + old) for old in order] + [top] * len(finals)


_BLOCKS = "block bigint, item_ids array<bigint>, terms array<binary>, sizes array<int>, children array<int>, levels array<int>"
_BLOCK_FIELDS = [
    ("block", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())),
    ("sizes", pa.list_(pa.int32())), ("children", pa.list_(pa.int32())), ("levels", pa.list_(pa.int32())),
]


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (block,), group in stream_groups(batches, ["block"]):
        texts: dict[int | None, set[bytes]] = {}
        for item, text in zip(group.column("item_id").to_pylist(), group.column("text").to_pylist(), strict=True):
            texts.setdefault(item, set()).update(terms_of(text))
        texts = {item: found for item, found in texts.items() if found}
        if not texts:
            continue
        terms = sorted(set().union(*texts.values()))
        number = {t: i for i, t in enumerate(terms)}
        children, levels = share([{number[t] for t in found} for found in texts.values()])
        row = [block, list(texts), terms, [len(c) for c in children], [c for node in children for c in node], levels]
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, (_, kind) in zip(row, _BLOCK_FIELDS, strict=True)], [n for n, _ in _BLOCK_FIELDS])


def query_blocks(items: DataFrame, item: str = "item_id", text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The items dealt into blocks, and each block's sharing DAG: a written table, a row per block.

    ``item_ids`` are the block's items with terms, ``terms`` its leaves; ``children`` (cut by
    ``sizes``) and ``levels`` describe the inner nodes.  Rows that share an id are one item.
    """
    source = items.select(F.col(item).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text"))
    size = source.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    # a term and its separator take two characters at least; six are usual
    blocks = max(1, -(-size["n"] // block_items), -(-size["chars"] // (6 * BLOCK_TERMS)))
    dealt = source.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    return written(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_mine, _BLOCKS), "query-blocks")


def _split(batches: Iterator[pa.RecordBatch], asked) -> Iterator[pa.RecordBatch]:
    number = asked.value
    for batch in batches:
        sizes, ends, ids, counts = [], [0], [], []
        for value in batch.column("text"):
            words = terms_of(value.as_py())
            found = Counter(map(number.get, words))
            found.pop(None, None)
            sizes.append(len(words))
            ids += found.keys()
            counts += found.values()
            ends.append(len(ids))
        ends = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))]
        made = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])
        yield made.filter(pa.array(np.array(sizes, dtype=np.int64) > 0))


class Block:
    """A block's DAG with its leaves' numbers in the forward table."""

    def __init__(self, row, number: dict[bytes, int]):
        self.items: list[int | None] = row["item_ids"]
        leaves = len(row["terms"])
        self.leaf = np.full(len(number), -1, dtype=np.int64)
        self.leaf[[number[bytes(t)] for t in row["terms"]]] = np.arange(leaves)
        sizes, levels = np.array(row["sizes"]), np.array(row["levels"])
        children, ends = np.array(row["children"], dtype=np.int64), np.concatenate([[0], np.cumsum(sizes)])
        self.leaves, self.nodes = leaves, leaves + len(sizes)
        self.steps = []
        for level in np.unique(levels):
            at = np.flatnonzero(levels == level)  # consecutive
            a, b = ends[at[0]], ends[at[-1] + 1]
            self.steps.append((leaves + at[0], leaves + at[-1] + 1, children[a:b], ends[at] - a))

    def scores(self, terms: np.ndarray, documents: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
        """Items x documents, from the values of (term, document) entries."""
        leaf = self.leaf[terms]
        mine = leaf >= 0
        sums = np.zeros((self.nodes, width), dtype=np.int64)
        sums[leaf[mine], documents[mine]] = values[mine]
        for first, last, children, starts in self.steps:
            np.add.reduceat(sums[children], starts, axis=0, out=sums[first:last])
        return sums[self.nodes - len(self.items) :]


def values_of(counts: np.ndarray, weights: np.ndarray, damping: np.ndarray) -> np.ndarray:
    """The integer value of each (term, document) entry."""
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * damping))


_NO_ID = (1 << 63) - 1  # stands for a null id while sorting: last


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((doc, -score, item))
    item, score, doc = item[order], score[order], doc[order]
    starts = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.append(starts, len(item))))
    return item[rank < top], score[rank < top], doc[rank < top]


def _evaluate(batches: Iterator[pa.RecordBatch], portion, corpus: tuple[int, int], top: int) -> Iterator[pa.RecordBatch]:
    rows, number, weights = portion.value
    n_docs, n_terms = corpus
    blocks = [Block(row, number) for row in rows]
    kept = [(np.zeros(0, np.int64),) * 3 for _ in blocks]
    floors = [np.ones(len(b.items), dtype=np.int64) for b in blocks]  # scores below cannot be among the best
    for whole in batches:
        for at in range(0, whole.num_rows, DOCUMENTS):
            batch = whole.slice(at, DOCUMENTS)
            doc = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            damping = np.array([10 + (90 * n * n_docs) // n_terms for n in batch.column("n").to_pylist()], dtype=np.int64)
            lists = batch.column("terms")
            sizes = np.diff(lists.offsets.to_numpy())
            terms, counts = lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            documents = np.repeat(np.arange(len(doc)), sizes)
            values = values_of(counts, weights[terms], damping[documents])
            for i, block in enumerate(blocks):
                scores = block.scores(terms, documents, values, len(doc))
                item, column = np.nonzero(scores >= floors[i][:, None])
                if not len(item):
                    continue
                new = (item, scores[item, column], doc[column])
                kept[i] = _best(*(np.concatenate(pair) for pair in zip(kept[i], new, strict=True)), top)
                item, score, _ = kept[i]
                full = np.bincount(item, minlength=len(block.items)) >= top
                last = np.full(len(block.items), _NO_ID, dtype=np.int64)
                np.minimum.at(last, item, score)
                floors[i] = np.where(full, last, 1)
    for block, (item, score, doc) in zip(blocks, kept, strict=True):
        names = pa.array(block.items, pa.int64()).take(pa.array(item))
        yield pa.RecordBatch.from_arrays([names, pa.array(doc, mask=doc == _NO_ID), pa.array(score)], ["item_id", "doc_id", "score"])


def _portions(blocks: DataFrame) -> Iterator[list]:
    """Rows of the blocks in portions of a bounded size, one portion on the driver at a time."""
    size = F.length(F.array_join(F.transform("terms", lambda t: F.hex(t)), "")) / 2 + 8 * (F.size("terms") + F.size("children") + 2 * F.size("sizes"))
    sized = blocks.select("block", size.cast("bigint").alias("bytes")).orderBy("block")
    held, total = [], 0
    for row in sized.toLocalIterator():  # two numbers per block
        if held and total + row["bytes"] > PORTION_BYTES:
            yield blocks.where(F.col("block").between(held[0], held[-1])).collect()
            held, total = [], 0
        held.append(row["block"])
        total += row["bytes"]
    if held:
        yield blocks.where(F.col("block").between(held[0], held[-1])).collect()


def _first(ranked_in: list[Column | str], top: int, df: DataFrame) -> DataFrame:
    window = Window.partitionBy(*ranked_in).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, doc: str = "doc_id", item: str = "item_id", text: str = "text", block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0.

    The statistics (documents and terms of the corpus, documents per term) are of all of
    ``docs``.  Equal scores rank by ascending document id, null ids last.  A null text has no
    terms; documents without terms count for nothing, items without terms have no rows.
    Rows that share an item id are one item, a null id being one; document rows that share
    an id are documents of their own.  Very long texts are split one at a time.  Empty
    tables give no rows.  Other columns are ignored.  Scores are 64-bit integers.
    """
    spark = docs.sparkSession
    blocks = query_blocks(items, item, text, block_items)
    source = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    for rows in _portions(blocks):
        number = {t: i for i, t in enumerate(sorted({bytes(t) for row in rows for t in row["terms"]}))}
        asked = spark.sparkContext.broadcast(number)
        forward = written(source.mapInArrow(partial(_split, asked=asked), "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"), "forward")
        corpus = forward.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not corpus["docs"]:
            break
        # a number per term of the portion, whatever the corpus
        held = forward.select(F.explode("terms").alias("term")).groupBy("term").count()
        holding = np.zeros(len(number), dtype=np.int64)
        for row in held.collect():
            holding[row["term"]] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * corpus["docs"] + 2) / (2 * int(n) + 1))) for n in holding], dtype=np.int64)
        portion = spark.sparkContext.broadcast((rows, number, weights))
        evaluated = partial(_evaluate, portion=portion, corpus=(corpus["docs"], corpus["terms"]), top=top)
        found = found.unionByName(forward.mapInArrow(evaluated, "item_id bigint, doc_id bigint, score bigint"))
    # tasks' bests meet in two steps, so that no task gets an item's rows of all tasks
    near = _first(["item_id", "part"], top, found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))).drop("part", "rank")
    return _first(["item_id"], top, near).select("item_id", "rank", "doc_id", "score")
