"""Near-duplicate photo search over 64-bit perceptual hashes.

Two hashes within ``k`` bits differ in at most ``k`` of ``m`` bit blocks, so they agree
on some choice of ``m - k`` blocks.  Listing every hash under each such choice turns
"Hamming distance <= k" into an equi-join that loses nothing.  More blocks give longer
keys: more rows per hash, fewer chance meetings; ``choose_blocks`` weighs the two.
Only the first block of a choice (or the first few) is listed by Spark: hashes that share
it meet in one task, which lists the rest of the choices in memory, so that a hash is
shuffled ``k + 1`` times and not once per choice.

Records only enter through their distinct hashes.  For every hash the search keeps, per
distance, the smallest record id seen at that distance, so a hash shared by a third of
all records costs one row, and no pair of records is ever formed.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations
from math import comb
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinlens.constants import DUPLICATE_MAX_HAMMING
from basinlens.functions.geo import hamming
from basinlens.operators.common import split_hot_join
from basinlens.operators.hash_groups import PACKED_SCHEMA, group_search, pack_groups, unpacked
from basinlens.session import cut_lineage

if TYPE_CHECKING:
    from basinlens.operators.hash_index import HashIndex

GROUP_ROWS = 2_000_000  # hashes that a task searches as one group
TASK_ROWS = 500_000  # hashes, with their copies, that a task searches in all its groups
GROUP_COST = 4.0  # a key listed in memory costs about as much as so many chance meetings (see choose_blocks)


def choose_blocks(n_hashes: int, k: int = DUPLICATE_MAX_HAMMING, row_cost: float = 30.0) -> int:
    """Block count with the least expected work per hash.

    Listing a key (shuffle and sort of a row) costs about ``row_cost`` chance meetings.
    """

    def work(m: int) -> float:
        keys = comb(m, k)
        key_bits = 64 * (m - k) / m
        return keys * (row_cost + n_hashes / 2.0**key_bits)

    return min(range(k + 1, k + 7), key=work)


def block_masks(blocks: int, k: int = DUPLICATE_MAX_HAMMING) -> list[int]:
    """Signed 64-bit masks, one per choice of ``blocks - k`` blocks."""
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << hi) - (1 << lo)) for lo, hi in zip(bounds, bounds[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(block, blocks - k)]


def _signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >= 1 << 63 else value


def hash_keys(hashes: DataFrame, blocks: int, k: int = DUPLICATE_MAX_HAMMING, number: str | None = None) -> DataFrame:
    """``hashes`` repeated once per block choice, with a 64-bit ``key`` per choice (and the choice's ``number``).

    The key is the masked hash mixed with a constant of its choice.  Keys of two choices
    may coincide; that only adds a candidate, which the distance test then judges.
    """
    keys = [
        F.col("phash").bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(_signed((i + 1) * 0x9E3779B97F4A7C15)))
        for i, m in enumerate(block_masks(blocks, k))
    ]
    if number:
        return hashes.select("*", F.posexplode(F.array(*keys)).alias(number, "key"))
    return hashes.select("*", F.explode(F.array(*keys)).alias("key"))


def stored_hashes(photos: DataFrame) -> DataFrame:
    """Distinct ``phash`` with the first and last record that carries it, and how many photos do."""
    ids = F.col("record_id")
    found = photos.where("phash is not null").groupBy("phash")
    return found.agg(F.min(ids).alias("first_id"), F.max(ids).alias("last_id"), F.count(F.lit(1)).alias("n"))


def leading_choices(blocks: int, depth: int, k: int = DUPLICATE_MAX_HAMMING) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """Per choice of ``depth`` blocks its mask and how it goes on: (mask of further blocks, masks of blocks that differ).

    A pair within ``k`` bits has at least ``blocks - k`` equal blocks.  It belongs to the choice
    of its first ones, so all others before the last of them differ, and meets once.
    """
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << hi) - (1 << lo)) for lo, hi in zip(bounds, bounds[1:])]
    out: dict[tuple[int, ...], list[tuple[int, list[int]]]] = {}
    for chosen in combinations(range(blocks), blocks - k):
        differ = [block[i] for i in range(chosen[-1]) if i not in chosen]
        out.setdefault(chosen[:depth], []).append((sum(block[i] for i in chosen[depth:]), differ))
    return [(sum(block[i] for i in lead), rest) for lead, rest in out.items()]


def lead_keys(hashes: DataFrame, blocks: int, k: int = DUPLICATE_MAX_HAMMING) -> DataFrame:
    """``hashes`` repeated once per choice of a first equal block, with its number (``choice``) and a ``key``."""
    leads = [F.col("phash").bitwiseAND(F.lit(_signed(mask))) for mask, _ in leading_choices(blocks, 1, k)]
    # the choice is part of the key: a key's task looks for the pairs of one choice
    keys = [F.xxhash64(F.lit(i), lead) for i, lead in enumerate(leads)]
    return hashes.select("*", F.posexplode(F.array(*keys)).alias("choice", "key"))


def choose_depth(n_hashes: int, blocks: int, k: int = DUPLICATE_MAX_HAMMING, rows: int | None = None) -> int:
    """How many blocks a group shares, so that one of evenly spread hashes holds a quarter of ``rows`` at most."""
    rows = GROUP_ROWS if rows is None else rows
    fits = (d for d in range(1, blocks - k) if n_hashes / 2.0 ** (64 * d / blocks) <= rows / 4)
    return next(fits, blocks - k)


def near_hashes(
    probe: DataFrame, stored: DataFrame, blocks: int, k: int = DUPLICATE_MAX_HAMMING, history: str = "before", n: int | None = None
) -> DataFrame:
    """Per probe hash: ``first_d`` (and for history "all" ``last_d``), the extreme record ids stored at distance d.

    ``stored`` may be keyed already (entries of a hash index).  ``n``: how many hashes both
    sides hold.  Searched against itself (``stored is probe``), a hash meets its own records
    at distance 0, and for history "before" ids that no record follows are left out.
    """
    ends = ["first", "last"] if history == "all" else ["first"]
    ids = [f"{e}_id" for e in ends]
    if "key" in stored.columns:
        right = stored.select("key", F.col("phash").alias("_other"), *ids)
        both = _met(hash_keys(probe.select("phash"), blocks, k), right, k, ids)
    else:
        both = _near_in_groups(probe, stored, blocks, k, ends, probe.count() + stored.count() if n is None else n)
    pick = {"first": F.min, "last": F.max}
    columns = [
        pick[e](F.when(F.col("_d") == d, F.col(f"{e}_id"))).alias(f"{e}_{d}") for d in range(k + 1) for e in ends
    ]
    return both.groupBy("phash").agg(*columns)


def _met(left: DataFrame, right: DataFrame, k: int, ids: list[str]) -> DataFrame:
    """Pairs of equal ``key`` within ``k`` bits."""
    # the keys outnumber the hashes many times over, which size estimates do not see: never broadcast them
    met = left.hint("merge").join(right, "key").withColumn("_d", hamming(F.col("phash"), F.col("_other")))
    return met.where(F.col("_d") <= k).select("phash", "_d", *ids)


def _near_in_groups(probe: DataFrame, stored: DataFrame, blocks: int, k: int, ends: list[str], n: int) -> DataFrame:
    """(phash, _d, ids) of near hashes, by groups of hashes that share their first equal blocks.

    A hash goes to one group per choice of those (7 for one block and distance 6), and a task
    lists the longer keys of a group in memory.  Ids that are integers are packed with the
    hashes, many to a row.  Groups of more than ``GROUP_ROWS`` are listed by Spark instead,
    under all their keys, and joined.
    """
    ids, same = [f"{e}_id" for e in ends], stored is probe
    before = same and ends == ["first"]
    sides = ["phash", "asks", "stored", *(["first_id", "last_id"] if before else ids)]
    rows = stored.withColumns({"asks": F.lit(same), "stored": F.lit(True)}).select(*sides)
    if not same:
        asking = probe.select("phash").withColumns({"asks": F.lit(True), "stored": F.lit(False)})
        rows = rows.unionByName(asking, allowMissingColumns=True)
    choices = leading_choices(blocks, choose_depth(n, blocks, k), k)
    leads = F.array(*[F.col("phash").bitwiseAND(F.lit(_signed(mask))) for mask, _ in choices])
    listed = rows.select("*", F.posexplode(leads).alias("_choice", "_lead"))
    schema = "phash bigint, _d int, " + ", ".join(f"{c} {stored.schema[c].dataType.simpleString()}" for c in ids)

    numbered = all(stored.schema[c].dataType.typeName() == "long" for c in sides[3:])

    def search(key: tuple, table: pa.Table) -> pa.Table:
        table = unpacked(table, sides[3:]) if numbered else table
        return group_search(table, choices[key[0].as_py()][1], k, ends, before)

    large = []
    if n > GROUP_ROWS:  # at most len(choices) * n / GROUP_ROWS keys
        sizes = listed.groupBy("_choice", "_lead").agg(F.count(F.lit(1)).alias("_n"))
        large = [(r[0], r[1]) for r in sizes.where(F.col("_n") > GROUP_ROWS).collect()]
    parts = []
    if large:
        hot = F.broadcast(probe.sparkSession.createDataFrame(large, "_choice int, _lead bigint"))
        over, listed = listed.join(hot, ["_choice", "_lead"], "left_semi"), listed.join(hot, ["_choice", "_lead"], "left_anti")
        keys = F.lit(None).cast("array<bigint>")
        for c in {c for c, _ in large}:
            lead, rest = choices[c]
            masked = [F.col("phash").bitwiseAND(F.lit(_signed(lead | mask))) for mask, _ in rest]
            mixed = [key.bitwiseXOR(F.lit(_signed((c * 1009 + i + 1) * 0x9E3779B97F4A7C15))) for i, key in enumerate(masked)]
            keys = F.when(F.col("_choice") == c, F.array(*mixed)).otherwise(keys)
        keyed = over.select(*sides, F.explode(keys).alias("key"))
        right = keyed.where("stored").select("key", F.col("phash").alias("_other"), *ids)
        parts.append(_met(keyed.where("asks").select("key", "phash"), right, k, ids))
    if numbered:  # a stored row without an id is nobody's photo
        kept = rows.where("not stored or first_id is not null")
        pack = partial(pack_groups, leads=[lead for lead, _ in choices], ids=sides[3:], left_out=frozenset(large))
        tasks = max(1, -(-n * len(choices) // TASK_ROWS))
        listed = kept.mapInArrow(pack, PACKED_SCHEMA).repartition(tasks, "_choice", "_lead")
    parts.append(listed.groupBy("_choice", "_lead").applyInArrow(search, schema))
    if same:
        own = stored.where("first_id < last_id") if before else stored
        parts.append(own.select("phash", F.lit(0).alias("_d"), *ids))
    return reduce(DataFrame.unionByName, parts)


def _least_distance(k: int, history: str) -> Column:
    """Smallest d at which a record before this one (or any other record) has a photo."""
    tests = []
    for d in range(k + 1):
        hit = F.col(f"first_{d}") < F.col("record_id")
        if history == "all":
            hit = hit | (F.col(f"last_{d}") > F.col("record_id"))
        tests.append(F.when(hit, F.lit(d)))
    return F.coalesce(*tests)


def duplicate_distance(
    photos: DataFrame,
    history: str = "before",
    blocks: int | None = None,
    k: int = DUPLICATE_MAX_HAMMING,
    stored: DataFrame | None = None,
    index: HashIndex | None = None,
    before: int | None = None,
) -> DataFrame:
    """``record_id, min_distance``: least Hamming distance <= k to a stored photo of another record.

    ``photos``: record_id, phash (bigint, null when missing or unreadable), one row per photo.
    ``history='before'`` compares with smaller record ids only, as ingest order does;
    ``'all'`` with every other record.  ``stored`` holds hashes of earlier loads, which
    count whatever their record ids are, but for the record itself; an ``index`` holds them
    listed by key, as they were before batch ``before``, and its blocks are used.
    Records without a near photo are absent.  The distinct hashes are written once
    (checkpoint); without ``blocks`` their number chooses it.
    """
    readable = photos.where("phash is not null").select("record_id", "phash")
    own = cut_lineage(stored_hashes(readable))  # read several times below
    against = [(own, history)] + ([] if stored is None else [(stored.select("phash", "first_id", "last_id", "n"), "all")])
    entries = None if index is None else index.entries(own, before)
    if entries is not None:
        # entries that are not keyed are the whole history, read for its number and for the search
        against += [(entries if "key" in entries.columns else cut_lineage(entries), "all")]
    n = sum(known.count() for known, _ in against if "key" not in known.columns)
    if blocks is None:
        blocks = choose_blocks(n, k, GROUP_COST)
    found = []
    for known, which in against:
        keyed = "key" in known.columns
        near = near_hashes(own, known, index.blocks if keyed else blocks, k, which, n)
        joined = split_hot_join(readable, near, "phash", spread="record_id", counts=own)
        found.append(joined.select("record_id", _least_distance(k, which).alias("_d")).where("_d is not null"))
    return reduce(DataFrame.unionByName, found).groupBy("record_id").agg(F.min("_d").alias("min_distance"))
