"""A keyed table as a log of segments: appended, merged on read, compacted tier by tier.

An append writes one segment and then names it in a new manifest, whose file appears by
one rename.  Until then readers see the old state, so a crash in between leaves a folder
that nobody names.  A manifest knows the last batch that it holds: appending a batch again
changes nothing, and a reader can ask for the state before a batch.

Rows lie in ranges of the hash of their range key, a folder per range, so many that one
holds about ``range_rows`` rows.  A reader that names the keys it looks for reads their
ranges only.  As soon as ``fan`` segments are of one tier they are merged into one of the
next tier: an append costs what it appends, and a row is rewritten once per tier.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basinlens.operators.common import latest_by_key

HIDDEN = ("_seq", "_range")
_NOTHING = {"version": 0, "batch": None, "segments": [], "meta": {}}


def newest(keys: Sequence[str], version: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge rule: the newest row of each key.

    Order: ``version``, then the later append, then the larger hash of the row, so that
    rows of one key within one append are resolved the same way on every run.
    """

    def merge(rows: DataFrame) -> DataFrame:
        plain = [f.name for f in rows.schema if f.name != "_seq" and "map<" not in f.dataType.simpleString()]
        tied = rows.withColumn("_tie", F.xxhash64(*plain))
        return latest_by_key(tied, keys, [*version, "_seq", "_tie"]).drop("_tie")

    return merge


class SegmentTable:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        merge: Callable[[DataFrame], DataFrame],
        range_keys: Sequence[str],
        fan: int = 8,
        range_rows: int = 1_000_000,
        merged: bool = False,
    ):
        """``merge`` makes one row of each key's rows; it may be applied again to rows it made.

        ``merged``: who appends keeps (persists) one row per key, which is written as it is.
        """
        self.merged = merged
        self.spark, self.path, self.merge = spark, path.rstrip("/"), merge
        self.range_keys, self.fan, self.range_rows = list(range_keys), fan, range_rows

    # --- manifests ------------------------------------------------------------------

    def _hadoop(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return jvm, folder, folder.getFileSystem(conf), conf

    def _versions(self) -> list[int]:
        _, folder, files, _ = self._hadoop()
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict:
        jvm, folder, files, _ = self._hadoop()
        stream = files.open(jvm.org.apache.hadoop.fs.Path(folder, f"{version:012d}.json"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self, before: int | None = None) -> dict:
        """The newest manifest, or the newest of those without batch ``before`` and later ones."""
        for version in reversed(self._versions()):
            manifest = self._manifest(version)
            if before is None or manifest["batch"] is None or manifest["batch"] < before:
                return manifest
        return dict(_NOTHING)

    def _commit(self, manifest: dict) -> None:
        jvm, folder, files, conf = self._hadoop()
        jpath = jvm.org.apache.hadoop.fs.Path
        files.mkdirs(folder)
        staged = jpath(folder, f".staged-{uuid.uuid4().hex}")
        stream = files.create(staged, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        refuse = self.spark.sparkContext._gateway.new_array(kind, 1)
        refuse[0] = kind.NONE  # a version that another writer has committed makes this fail
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf)
        context.rename(context.makeQualified(staged), context.makeQualified(jpath(folder, f"{manifest['version']:012d}.json")), refuse)

    # --- rows -----------------------------------------------------------------------

    def _range(self, bits: int):
        return F.shiftrightunsigned(F.xxhash64(*self.range_keys), 64 - bits) if bits else F.lit(0).cast("bigint")

    def _write_segment(self, rows: DataFrame, tier: int, merged: bool = False) -> dict:
        """``rows`` (with _seq) merged (unless they are), counted and written by range."""
        rows = rows if merged else self.merge(rows).persist()
        count = rows.count()
        bits = max(0, math.ceil(math.log2(max(1, count) / self.range_rows)))
        folder = f"segments/{uuid.uuid4().hex}"
        ranged = rows.withColumn("_range", self._range(bits))
        if bits:
            ranged = ranged.repartition("_range")
        ranged.write.partitionBy("_range").parquet(f"{self.path}/{folder}")
        if not merged:
            rows.unpersist()
        return {"path": folder, "tier": tier, "bits": bits, "rows": count, "schema": rows.schema.json()}

    def append(self, rows: DataFrame, batch: int | None = None, meta: dict | None = None) -> bool:
        """Add rows; False if the table already holds ``batch`` (batches come in ascending order)."""
        now = self.state()
        if batch is not None and now["batch"] is not None and now["batch"] >= batch:
            return False
        version = now["version"] + 1
        segment = self._write_segment(rows.withColumn("_seq", F.lit(version).cast("bigint")), 0, self.merged)
        segments = [*now["segments"], segment] if segment["rows"] else now["segments"]
        now = {"version": version, "batch": now["batch"] if batch is None else batch, "segments": segments, "meta": now["meta"] | (meta or {})}
        self._commit(now)
        self.compact(now)
        return True

    def compact(self, now: dict | None = None) -> None:
        """Merge tiers that hold ``fan`` segments."""
        now = now or self.state()
        while True:
            tiers = [s["tier"] for s in now["segments"]]
            full = next((t for t in sorted(set(tiers)) if tiers.count(t) >= self.fan), None)
            if full is None:
                return
            old = [s for s in now["segments"] if s["tier"] == full]
            merged = self._write_segment(self._union(old), full + 1)
            now = now | {"version": now["version"] + 1, "segments": [*(s for s in now["segments"] if s["tier"] != full), merged]}
            self._commit(now)

    def _segment(self, segment: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(segment["schema"])).add("_range", T.LongType())
        return self.spark.read.schema(schema).parquet(f"{self.path}/{segment['path']}")

    def _union(self, segments: list[dict], touched: tuple[int, list[int]] | None = None) -> DataFrame:
        parts = []
        for s in segments:
            part = self._segment(s)
            if touched and s["bits"]:
                bits, ranges = touched
                part = part.where(F.col("_range").isin(sorted({r >> (bits - s["bits"]) for r in ranges})))
            parts.append(part.drop("_range"))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def scan(self, probe: DataFrame | None = None, before: int | None = None, state: dict | None = None) -> DataFrame | None:
        """Stored rows, not yet merged, of the ranges that ``probe`` (with the range keys) touches; None of an empty table."""
        segments = (state or self.state(before))["segments"]
        if not segments:
            return None
        bits = max(s["bits"] for s in segments)
        touched = None
        if probe is not None and bits:
            # at most one number per range
            touched = bits, [r[0] for r in probe.select(self._range(bits)).distinct().collect()]
        return self._union(segments, touched)

    def read(self, probe: DataFrame | None = None, before: int | None = None) -> DataFrame | None:
        """One row per key.  With ``probe`` only keys in the ranges that it touches; None of an empty table."""
        state = self.state(before)
        rows = self.scan(probe, before, state)
        if rows is None:
            return None
        # a segment alone holds one row per key
        return (rows if len(state["segments"]) == 1 else self.merge(rows)).drop(*HIDDEN)

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the newest ``keep`` manifests, and segments that no manifest names; returns how many segments.

        Not while another writer appends, nor while readers of older states run.
        """
        jvm, folder, files, _ = self._hadoop()
        jpath = jvm.org.apache.hadoop.fs.Path
        versions = self._versions()
        for version in versions[:-keep]:
            files.delete(jpath(folder, f"{version:012d}.json"), False)
        named = {s["path"].split("/")[1] for v in versions[-keep:] for s in self._manifest(v)["segments"]}
        data = jpath(f"{self.path}/segments")
        unnamed = [s.getPath() for s in files.listStatus(data) if s.getPath().getName() not in named] if files.exists(data) else []
        for path in unnamed:
            files.delete(path, True)
        return len(unnamed)
