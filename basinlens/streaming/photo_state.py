"""Near-duplicate search over an endless stream, with one state entry per hash and key.

Each photo hash is listed under its block choices (see ``operators.photos``); the state of
a key lists the hashes seen there, each once, with their first record, whatever the number of records that
share a hash.  A hash is listed under its first equal blocks only (7 keys for distance 6), and
the longer keys are listed within a key's task.  A key that comes to hold more than ``bound``
hashes (many photos with a dark corner, say) hands its entries on to a second level and keeps none from then on: hashes
under one key agree in its blocks, so the second level cuts the remaining bits into blocks
and lists them by choices of those.  Nothing is lost at either level.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from basinlens.constants import DUPLICATE_MAX_HAMMING
from basinlens.operators.hash_groups import Choices, near_pairs
from basinlens.operators.photos import GROUP_COST, choose_blocks, leading_choices, lead_keys

OUTPUT = T.StructType([T.StructField("record_id", T.LongType()), T.StructField("distance", T.IntegerType())])
_LEVEL = T.StructType(
    [T.StructField("key", T.LongType()), T.StructField("record_id", T.LongType()), T.StructField("phash", T.LongType()), T.StructField("distance", T.IntegerType())]
)
# hashes and their first records of one batch, eight bytes each: a key's history is read in a few large values
_ENTRY = T.StructType([T.StructField("hashes", T.BinaryType()), T.StructField("first_ids", T.BinaryType())])
_MOVED = T.StructType([T.StructField("moved", T.BooleanType())])

ROW_COST = 300_000.0  # of a state whose hashes of one key are all compared: a keyed row costs a state access (see choose_blocks)
BOUND = 1_000_000  # hashes that a key may hold
SECOND_BLOCKS = 8  # blocks of the second level
COMPARED = 1 << 20  # distances computed at a time
DIRECT = 256  # so many new hashes of a key are compared with all others, more are looked up by longer keys
FOLDED = 1 << 18  # rows of a batch collected before they are reduced to distinct hashes
PASSING = 64  # keys by which finished rows pass the second level
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def second_masks(blocks: int, k: int) -> np.ndarray:
    """Per choice of the first level (rows): masks of the choices among the bits that it leaves open."""
    out = []
    for kept, _ in leading_choices(blocks, 1, k):
        free = [b for b in range(64) if not kept >> b & 1]
        cuts = [round(len(free) * i / SECOND_BLOCKS) for i in range(SECOND_BLOCKS + 1)]
        parts = [sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        out.append([sum(chosen) for chosen in combinations(parts, SECOND_BLOCKS - k)])
    return np.array(out, dtype=np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    """64-bit mixing (a fixed public finalizer)."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(33))


Hashes = tuple[np.ndarray, np.ndarray]  # distinct hashes, ascending, and the smallest record id of each
NONE: Hashes = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _distinct(hashes: list[np.ndarray], ids: list[np.ndarray]) -> tuple[Hashes, np.ndarray]:
    """The hashes with their smallest record id, and the ids that come after another record of their hash."""
    h, i = np.concatenate(hashes), np.concatenate(ids)
    order = np.lexsort((i, h))
    h, i = h[order], i[order]
    first = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    least = i[np.flatnonzero(first)][np.cumsum(first) - 1]
    return (h[first], i[first]), i[i > least]


class _NearHashes(StatefulProcessor):
    def __init__(self, k: int, bound: int | None, masks: np.ndarray | None, expire_ms: int | None, choices: list[Choices] | None = None):
        self.k, self.bound, self.masks, self.expire_ms, self.choices = k, bound, masks, expire_ms, choices

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a list, since every batch appends its new hashes as one entry
        self.seen = handle.getListState("seen", _ENTRY, self.expire_ms)
        self.moved = handle.getValueState("moved", _MOVED) if self.bound else None

    def _second(self, key: int, choice: int, hashes: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        """Rows of the second level: every hash under each choice of the open bits, within its first key."""
        masks = self.masks[choice]
        own = np.array([key], dtype=np.int64).view(np.uint64)
        number = np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys = _mixed((hashes.view(np.uint64)[:, None] & masks[None, :]) ^ _mixed(number ^ own)[None, :])
        n = len(masks)
        rows = {"key": keys.ravel().view(np.int64), "record_id": np.repeat(ids, n), "phash": np.repeat(hashes, n), "distance": pd.array([None] * (len(ids) * n), dtype="Int32")}
        return pd.DataFrame(rows)

    def _found(self, ids: list[int] | np.ndarray, distance: list[int] | np.ndarray) -> pd.DataFrame:
        ids = np.asarray(ids, dtype=np.int64)
        rows = {"key": ids % PASSING, "record_id": ids, "phash": np.zeros(len(ids), np.int64), "distance": pd.array(distance, dtype="Int32")}
        return pd.DataFrame(rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        key, choice = int(key[0]), 0
        moved = self.moved is not None and self.moved.exists()
        stored: Hashes | None = None
        pending, fresh, held = NONE, [], 0  # of this batch: hashes whose smallest id's distance is open
        for part in rows:
            passing = part[part["distance"].notna()]
            if len(passing):
                yield passing
                part = part[part["distance"].isna()]
                if not len(part):
                    continue
            hashes, ids = part["phash"].to_numpy(np.int64), part["record_id"].to_numpy(np.int64)
            choice = int(part["choice"].iloc[0]) if self.choices else 0
            if moved:
                yield self._second(key, choice, hashes, ids)
                continue
            fresh.append((hashes, ids))
            held += len(ids)
            if held < FOLDED:
                continue
            pending, later = self._fold(pending, fresh)
            fresh, held = [], 0
            yield self._found(later, np.zeros(len(later), np.int32))
            if self.bound and len(pending[0]) > self.bound // 2:
                stored = self._stored() if stored is None else stored
                if len(np.union1d(stored[0], pending[0])) > self.bound:
                    yield from self._move(key, choice, stored, pending)
                    moved, pending = True, NONE
        if fresh:
            # records after another of their own hash: distance 0, whatever comes
            pending, later = self._fold(pending, fresh)
            if len(later):
                yield self._found(later, np.zeros(len(later), np.int32))
        if len(pending[0]):
            stored = self._stored() if stored is None else stored
            if self.bound and len(np.union1d(stored[0], pending[0])) > self.bound:
                yield from self._move(key, choice, stored, pending)
                return
            found = self._compare(stored, pending, self.choices[choice] if self.choices else None)
            if len(found):
                yield found

    def _fold(self, pending: Hashes, fresh: list[Hashes]) -> tuple[Hashes, np.ndarray]:
        return _distinct([pending[0], *(h for h, _ in fresh)], [pending[1], *(i for _, i in fresh)])

    def _stored(self) -> Hashes:
        if not self.seen.exists():
            return NONE
        parts = [[np.frombuffer(bytes(column), np.int64) for column in entry] for entry in self.seen.get()]
        return _distinct([h for h, _ in parts], [i for _, i in parts])[0] if parts else NONE

    def _move(self, key: int, choice: int, stored: Hashes, pending: Hashes) -> Iterator[pd.DataFrame]:
        self.moved.update((True,))
        self.seen.clear()
        for hashes, ids in (stored, pending):
            for at in range(0, len(hashes), 4096):
                yield self._second(key, choice, hashes[at : at + 4096], ids[at : at + 4096])

    def _compare(self, stored: Hashes, pending: Hashes, choices: Choices | None) -> pd.DataFrame:
        """The batch joins the state first; "earlier" is then decided by record id alone."""
        own, rid = pending
        at = np.searchsorted(stored[0], own)
        known = at < len(stored[0])
        known[known] = stored[0][at[known]] == own[known]
        earlier = np.zeros(len(own), bool)  # their hash has an earlier record: distance 0
        earlier[known] = stored[1][at[known]] < rid[known]
        new = ~known
        new[known] = stored[1][at[known]] > rid[known]  # a smaller id of a known hash came later
        if new.any():
            self.seen.appendValue((own[new].tobytes(), rid[new].tobytes()))
        (h, first), _ = _distinct([stored[0], own[new]], [stored[1], rid[new]])
        ids, distances = [rid[earlier]], [np.zeros(int(earlier.sum()), np.int32)]
        own, rid = own[~earlier], rid[~earlier]
        if choices is None or len(own) <= DIRECT:
            step = max(1, COMPARED // max(1, len(h)))
            for start in range(0, len(own), step):
                some, r = own[start : start + step], rid[start : start + step]
                distance = np.bitwise_count((some[:, None] ^ h[None, :]).view(np.uint64)).astype(np.int32)
                distance[first[None, :] >= r[:, None]] = 99
                least = distance.min(axis=1)
                ids.append(r[least <= self.k])
                distances.append(least[least <= self.k])
            return self._found(np.concatenate(ids), np.concatenate(distances))
        least = np.full(len(h), 99, np.int32)
        asks = np.zeros(len(h), bool)
        asks[np.searchsorted(h, own)] = True
        for i, j, distance in near_pairs(h.view(np.uint64), choices, self.k):
            for a, b in ((i, j), (j, i)):
                use = asks[a] & (first[b] < first[a])
                np.minimum.at(least, a[use], distance[use].astype(np.int32))
        return self._found(np.append(ids[0], first[least <= self.k]), np.append(distances[0], least[least <= self.k]))

    def close(self) -> None:
        pass


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that keyed state needs; the given one keeps its settings."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def stream_duplicates(
    photos: DataFrame,
    expected: int = 10_000_000,
    k: int = DUPLICATE_MAX_HAMMING,
    blocks: int | None = None,
    bound: int | None = BOUND,
    expire_ms: int | None = None,
) -> DataFrame:
    """(record_id, distance) of photos near an earlier one; a record appears once per key that found it.

    ``photos``: record_id, phash (no nulls), of a session made by ``state_session``.  Blocks
    suit the ``expected`` number of hashes.  Within a micro-batch a smaller record id is
    earlier.  With ``expire_ms`` an entry is forgotten so long after it was last written
    (processing time).  Take the least distance per record downstream.
    """
    blocks = blocks or choose_blocks(expected, k, GROUP_COST)
    choices = [rest for _, rest in leading_choices(blocks, 1, k)]
    listed = lead_keys(photos.select("record_id", "phash"), blocks, k).withColumn("distance", F.lit(None).cast("int"))
    mode = {"outputMode": "Append", "timeMode": "ProcessingTime" if expire_ms else "None"}
    first = _NearHashes(k, bound, second_masks(blocks, k) if bound else None, expire_ms, choices)
    found = listed.groupBy("key").transformWithStateInPandas(statefulProcessor=first, outputStructType=_LEVEL, **mode)
    if bound:
        second = _NearHashes(k, None, None, expire_ms)
        found = found.groupBy("key").transformWithStateInPandas(statefulProcessor=second, outputStructType=_LEVEL, **mode)
    return found.select("record_id", "distance")


def least_distances(found: DataFrame) -> DataFrame:
    return found.groupBy("record_id").agg(F.min("distance").alias("min_distance"))
