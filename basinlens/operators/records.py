"""Record and evidence tables: details, lookups, upserts, partial updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinlens.operators.common import first_by_key, latest_by_key
from basinlens.sources.segments import SegmentTable, newest

RECORD_COLUMNS = [
    "record_id", "work_code", "mws_id", "category", "activity", "status", "lat", "lon", "gps_accuracy_m",
    "orientation", "captured_at", "photo1_url", "photo2_url", "photo1_phash", "photo2_phash", "remarks",
    "observer_id", "observer_name", "organisation", "is_synthetic", "photo_source", "created_at",
]
EVIDENCE_COLUMNS = [
    "geo_flags", "geo_score", "ai_result", "visual_score", "sat_result", "satellite_score", "temporal_score",
    "evidence_score", "band", "reviewer_decision", "reviewed_at", "scored_at",
]


def watershed_summaries(watersheds: DataFrame) -> DataFrame:
    """List view: everything but the geometry, oldest first."""
    return watersheds.drop("geom").orderBy("created_at", "mws_id")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Row of one id; empty when there is none.  The filter reaches the file scan."""
    return df.where(F.col(key) == F.lit(value))


def asset_detail(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """Record with its evidence; columns either side lacks are null."""
    left = records.select(
        *[F.col(c) if c in records.columns else F.lit(None).alias(c) for c in RECORD_COLUMNS]
    ).withColumn("is_synthetic", F.coalesce(F.col("is_synthetic").cast("boolean"), F.lit(False)))
    right = evidence.select(
        "record_id", *[F.col(c) if c in evidence.columns else F.lit(None).alias(c) for c in EVIDENCE_COLUMNS]
    )
    return left.join(right, "record_id", "left")


def attach_evidence(records: DataFrame, evidence: DataFrame, columns: Sequence[str]) -> DataFrame:
    return records.join(evidence.select("record_id", *columns), "record_id", "left")


def first_match(records: DataFrame, results: DataFrame, key: str = "record_id", position: str = "pos") -> DataFrame:
    """First result of each record; ``match_error`` where none exists or its score is no integer.

    ``results``: key, pos, satellite_score (text as delivered).
    """
    first = first_by_key(results, [key], [position]).withColumn("_found", F.lit(True))
    joined = records.select(key).join(first, key, "left")
    integer = F.when(F.col("satellite_score").rlike(r"^-?\d+$"), F.col("satellite_score")).try_cast("int")
    error = F.when(F.col("_found").isNull(), F.lit("no precomputed result")).when(
        integer.isNull(), F.lit("missing a valid integer satellite_score")
    )
    return joined.select(key, integer.alias("satellite_score"), error.alias("match_error"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Newest row per key over both inputs; within one version the incoming row wins."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(
        incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    return latest_by_key(both, keys, [*version, "_new"]).drop("_new")


def keyed_table(spark: SparkSession, path: str, keys: Sequence[str], version: Sequence[str], **options) -> SegmentTable:
    """A stored table of one row per key, the newest; see ``sources.segments`` for appends, reads and compaction."""
    return SegmentTable(spark, path, newest(keys, version), keys, **options)


def upsert_into(path: str, changes: DataFrame, keys: Sequence[str], version: Sequence[str], batch: int | None = None, **options) -> bool:
    """Keep the newest row per key in the table at ``path``, created on first use.

    Costs what ``changes`` hold, whatever the table's size.  A ``batch`` that the table
    already holds alters nothing (False).
    """
    return keyed_table(changes.sparkSession, path, keys, version, **options).append(changes, batch)


def insert_conflicts(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may be inserted, rows whose key is taken)."""
    taken = existing.select(*keys)
    return incoming.join(taken, list(keys), "left_anti"), incoming.join(taken, list(keys), "left_semi")


def patch_columns(target: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Overwrite ``columns`` of the rows named in ``patch``; a patch for an unknown row fails the job."""
    renamed = patch.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = target.withColumn("_known", F.lit(True)).join(renamed, key, "full_outer")
    refuse = F.when(
        F.col("_known").isNull(),
        F.raise_error(F.concat(F.lit("no row to update: "), F.col(key).cast("string"))).cast("boolean"),
    ).otherwise(F.lit(True))
    updated = [
        F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in target.columns
    ]
    return joined.where(refuse).select(*updated)


def resolve_entries(entries: DataFrame, candidates: DataFrame, primary: str, secondary: str, strict: bool = True):
    """Each entry's candidate by primary key, else by secondary key.

    ``entries``: entry.  Of candidates with one secondary key the last (by ``pos``) is
    used.  With ``strict`` an entry that matches neither fails the job.
    """
    by_primary = candidates.select(F.col(primary).cast("string").alias("entry"), F.struct(primary, secondary).alias("_p"))
    named = candidates.where(F.coalesce(F.col(secondary), F.lit("")) != "").select(
        F.col(secondary).alias("entry"), "pos", F.struct(primary, secondary).alias("_s")
    )
    by_secondary = latest_by_key(named, ["entry"], ["pos"]).select("entry", "_s")
    joined = entries.join(by_primary, "entry", "left").join(by_secondary, "entry", "left")
    found = F.coalesce("_p", "_s")
    if strict:
        message = F.concat(F.lit("entry not found among candidates: "), F.col("entry"))
        joined = joined.where(F.when(found.isNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    how = F.when(F.col("_p").isNotNull(), "primary").when(F.col("_s").isNotNull(), "secondary").otherwise("unresolved")
    return joined.select("entry", found[primary].alias(primary), found[secondary].alias(secondary), how.alias("resolved_by"))


def join_back_geometry(matches: DataFrame, geometries: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(matches with geometry, matches whose geometry is missing)."""
    return matches.join(geometries, key), matches.join(geometries.select(key), key, "left_anti")


def union_registers(*registers: DataFrame) -> DataFrame:
    """All entries, in one table, duplicates kept."""
    out = registers[0]
    for other in registers[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def missing_result(records: DataFrame, evidence: DataFrame, column: str = "ai_result") -> DataFrame:
    """Records whose evidence row is absent or has no ``column``."""
    done = evidence.where(F.col(column).isNotNull()).select("record_id")
    return records.join(done, "record_id", "left_anti")
