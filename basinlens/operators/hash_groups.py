"""Near pairs within one group of 64-bit hashes that agree in some blocks: the step that runs inside a task.

The groups are made by Spark (see ``operators.photos``): a hash is sent to one group per
choice of its first equal blocks only, seven times for distance 6, and the longer keys,
dozens per hash, are listed here, in memory, one sort of numbers each.

What a task sends to a group is one row: sorted hashes as differences, ids, and flags, each
as planes of equal bytes, which the shuffle's own compression shrinks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute

MIX = np.uint64(0x9E3779B97F4A7C15)
PACKED = 1 << 20  # hashes that a task packs at a time
HELD = 1 << 20  # pairs kept at a time, before they are reduced to the best per hash and distance


Choices = Sequence[tuple[int, Sequence[int]]]  # masks under which a pair agrees, each with those under which it differs


def near_pairs(hashes: np.ndarray, choices: Choices, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of rows within ``k`` bits that agree and differ as one of ``choices`` says, in one order of i and j."""
    n = len(hashes)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(n, dtype=np.uint64)
    for mask, differ in choices:
        # equal keys lie side by side; a chance meeting of two keys only adds a candidate
        keyed = ((hashes & np.uint64(mask)) * MIX & ~low) | place
        keyed.sort()
        order = (keyed & low).astype(np.int64)
        keyed >>= bits
        ordered = hashes[order]
        at = np.flatnonzero(keyed[1:] == keyed[:-1])
        step = 1
        while len(at):
            distance = np.bitwise_count(ordered[at] ^ ordered[at + step])
            hit = np.flatnonzero(distance <= k)
            if len(hit):
                left = at[hit]
                apart = ordered[left] ^ ordered[left + step]
                kept = np.ones(len(hit), dtype=bool)
                for block in differ:
                    kept &= apart & np.uint64(block) != 0
                left = left[kept]
                yield order[left], order[left + step], distance[hit[kept]].astype(np.int64)
            step += 1
            at = at[at + step < n]
            at = at[keyed[at] == keyed[at + step]]


def _best(slots: list[np.ndarray], values: list[np.ndarray], largest: bool) -> tuple[np.ndarray, np.ndarray]:
    slot, value = np.concatenate(slots), np.concatenate(values)
    order = np.lexsort((-value if largest else value, slot))
    slot, value = slot[order], value[order]
    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
    return slot[first], value[first]


class _Extremes:
    """The least (or largest) value per slot of what is added."""

    def __init__(self, largest: bool):
        self.largest, self.slots, self.values, self.held = largest, [], [], 0

    def add(self, slot: np.ndarray, value: np.ndarray) -> None:
        self.slots.append(slot)
        self.values.append(value)
        self.held += len(slot)
        if self.held > HELD:
            slot, value = self.result()
            # what is left may be large by itself: the next reduction comes after as many new ones
            self.slots, self.values, self.held = [slot], [value], 0

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.slots:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return _best(self.slots, self.values, self.largest)


def group_search(table: pa.Table, choices: Choices, k: int, ends: Sequence[str], before: bool) -> pa.Table:
    """Per hash of the asking rows and distance: the extreme record ids of stored rows of one group.

    ``table``: phash, asks, stored (booleans) and the ids.  With ``before`` an id counts only
    if the asking hash has a later record.
    """
    table = table.sort_by("first_id").combine_chunks()  # the place of a row is then the rank of its first record
    hashes = table["phash"].to_numpy().view(np.uint64)
    asks, stored = (table[c].to_numpy(zero_copy_only=False) for c in ("asks", "stored"))
    rank = {"first": np.arange(len(hashes), dtype=np.int64)}
    if before:  # the first row whose first record does not come before the last record of this one
        both = pa.chunked_array([*table["first_id"].chunks, *table["last_id"].chunks])
        dense = pa.compute.rank(both, tiebreaker="dense").to_numpy().astype(np.int64)
        first, last = dense[: len(hashes)], dense[len(hashes) :]
    by_rank = {"first": rank["first"]}
    if "last" in ends:
        by_rank["last"] = pa.compute.sort_indices(table["last_id"]).to_numpy().astype(np.int64)
        rank["last"] = np.empty_like(by_rank["last"])
        rank["last"][by_rank["last"]] = np.arange(len(hashes))
    found = {e: _Extremes(e == "last") for e in ends}
    for i, j, distance in near_pairs(hashes, choices, k):
        for a, b in ((i, j), (j, i)):
            use = asks[a] & stored[b]
            if before:
                use &= first[b] < last[a]
            slot = a[use] * (k + 1) + distance[use]
            for e in ends:
                found[e].add(slot, rank[e][b[use]])
    out = None
    for e in ends:
        slot, value = found[e].result()  # the same slots for both ends
        if out is None:
            out = {"phash": table["phash"].take(pa.array(slot // (k + 1))), "_d": pa.array((slot % (k + 1)).astype(np.int32))}
        out[f"{e}_id"] = table[f"{e}_id"].take(pa.array(by_rank[e][value]))
    return pa.table(out)


PACKED_SCHEMA = "_choice int, _lead bigint, rows int, packed binary"


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).view(np.int64).ravel()


def pack_groups(batches: Iterator[pa.RecordBatch], leads: Sequence[int], ids: Sequence[str], left_out: frozenset = frozenset()) -> Iterator[pa.RecordBatch]:
    """Rows (phash, asks, stored, 64-bit ``ids``) under each of ``leads`` (masks), one row a group; groups in ``left_out`` are not listed."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= PACKED:
            yield from _packed(pa.Table.from_batches(held), leads, ids, left_out)
            held, rows = [], 0
    if rows:
        yield from _packed(pa.Table.from_batches(held), leads, ids, left_out)


def _packed(table: pa.Table, leads: Sequence[int], ids: Sequence[str], left_out: frozenset) -> Iterator[pa.RecordBatch]:
    hashes = table["phash"].to_numpy().view(np.uint64)
    flags = table["asks"].to_numpy(zero_copy_only=False) + 2 * table["stored"].to_numpy(zero_copy_only=False).astype(np.uint8)
    columns = [pa.compute.fill_null(table[c], 0).to_numpy() for c in ids]  # rows that only ask have no ids
    columns = columns[:1] + [c - columns[0] for c in columns[1:]]  # a last record is mostly the first one
    for choice, mask in enumerate(leads):
        lead = hashes & np.uint64(mask)
        order = np.lexsort((hashes, lead))
        lead = lead[order].view(np.int64)
        starts = np.flatnonzero(np.append(True, lead[1:] != lead[:-1]))
        keys, sizes, blobs = [], [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            if (choice, int(lead[a])) in left_out:
                continue
            own = order[a:b]
            keys.append(lead[a])
            sizes.append(b - a)
            apart = np.diff(hashes[own], prepend=np.uint64(0))
            blobs.append(b"".join([_planes(apart), *(_planes(c[own]) for c in columns), flags[own].tobytes()]))
        arrays = [pa.array(np.full(len(keys), choice, np.int32)), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["_choice", "_lead", "rows", "packed"])


def unpacked(table: pa.Table, ids: Sequence[str]) -> pa.Table:
    """phash, asks, stored and ``ids`` of one group's packed rows."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in ("phash", "asks", "stored", *ids)}
    for n, blob in zip(table["rows"].to_pylist(), table["packed"].to_pylist(), strict=True):
        data = memoryview(blob)
        apart, *columns = (_from_planes(data[8 * n * i : 8 * n * (i + 1)], n) for i in range(1 + len(ids)))
        flags = np.frombuffer(data[8 * n * (1 + len(ids)) :], np.uint8)
        parts["phash"].append(np.cumsum(apart.view(np.uint64), dtype=np.uint64).view(np.int64))
        parts["asks"].append(flags & 1 != 0)
        parts["stored"].append(flags & 2 != 0)
        for i, c in enumerate(ids):
            parts[c].append(columns[i] + columns[0] if i else columns[0])
    return pa.table({c: np.concatenate(values) for c, values in parts.items()})
