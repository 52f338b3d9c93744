"""A kept inverted index of photo hashes: block key -> hashes listed under it, with their first and last records.

Written once per batch and probed only in the ranges of the keys that a batch looks for
(see ``sources.segments``); nothing of the history is keyed again.

That suits many small batches.  Where a batch is a good part of what is expected, listing
writes dozens of rows per hash to save few readings: such an index is plain, one row per
hash, and a batch is searched against the whole history (see ``photos.near_hashes``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinlens.constants import DUPLICATE_MAX_HAMMING
from basinlens.operators.photos import choose_blocks, hash_keys
from basinlens.sources.segments import SegmentTable

FEW_BATCHES = 64  # about so many readings of all hashes cost as much as listing them under their keys
ROW_COST = 300.0  # a listed key is written, merged tier by tier and read again (see choose_blocks)


def _ends(rows: DataFrame) -> DataFrame:
    ends = [F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n").alias("n"), F.max("_seq").alias("_seq")]
    return rows.groupBy("key", "phash").agg(*ends)


class HashIndex:
    def __init__(self, spark: SparkSession, path: str, blocks: int | None = None, expected: int = 10_000_000, k: int = DUPLICATE_MAX_HAMMING, **options):
        """A new index lists hashes under ``blocks`` blocks, by default those that suit ``expected`` hashes; an old one keeps its own.

        Without ``blocks`` the first batch decides whether the index is listed at all.
        """
        self.k = k
        self.table = SegmentTable(spark, path, _ends, ["key"], **options)
        meta = self.table.state()["meta"]
        self.listed = meta.get("listed", True if meta or blocks else None)  # None: the first batch decides
        self.expected = expected
        self.blocks = meta.get("blocks") or blocks or choose_blocks(expected, k, ROW_COST)

    def append(self, stored: DataFrame, batch: int | None = None) -> bool:
        """``stored``: phash, first_id, last_id, n (see ``photos.stored_hashes``)."""
        rows = stored.select("phash", "first_id", "last_id", "n")
        if self.listed is None:
            self.listed = rows.count() * FEW_BATCHES < self.expected
        keyed = hash_keys(rows, self.blocks, self.k) if self.listed else rows.withColumn("key", F.col("phash"))
        return self.table.append(keyed, batch, meta={"blocks": self.blocks, "listed": self.listed})

    def entries(self, hashes: DataFrame, before: int | None = None) -> DataFrame | None:
        """What the index holds near ``hashes`` (phash), as it was before batch ``before``.

        Of a listed index the entries, with ``key``, in the ranges of their keys; of a plain one all hashes.
        """
        if not self.listed:
            found = self.table.read(before=before)
            return None if found is None else found.select("phash", "first_id", "last_id", "n")
        probe = hash_keys(hashes.select("phash"), self.blocks, self.k)
        found = self.table.read(probe, before)
        return None if found is None else found.select("key", "phash", "first_id", "last_id")
