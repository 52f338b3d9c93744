"""Counts kept current: of events per event-time window, and of records by what they are now."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basinlens.sources.segments import SegmentTable


def windowed_counts(
    stream: DataFrame, keys: Sequence[str], ts: str = "ts", width: str = "1 day", late: str | None = "2 days"
) -> DataFrame:
    """Counts per window and key.  Rows later than the watermark are left out of the counts."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        timed = timed.withWatermark(ts, late)
    counts = timed.groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *keys, "n")


def keep_latest(counts: DataFrame, path: str, checkpoint: str, keys: Sequence[str], **trigger) -> StreamingQuery:
    """Update mode: each batch writes the windows it changed; ``current_counts`` reads the newest of each."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    trigger = trigger or {"availableNow": True}
    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def current_counts(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last value of every (window, key) among the written updates."""
    return written.groupBy("window_start", *keys).agg(F.max_by("n", "batch_id").alias("n"))


# --- counts of what records are now ---------------------------------------------------------

def _newest(rows: DataFrame) -> DataFrame:
    """One row per record: the newest version; of two rows of one version the one with the larger groups."""
    return rows.groupBy("record").agg(F.max(F.struct("version", "groups")).alias("_v"), F.max("_seq").alias("_seq")).select("record", "_v.*", "_seq")


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("group").agg(F.sum("delta").alias("delta"), F.max("_seq").alias("_seq"))


def _tables(spark: SparkSession, path: str, **options) -> tuple[SegmentTable, SegmentTable]:
    return SegmentTable(spark, f"{path}/records", _newest, ["record"], merged=True, **options), SegmentTable(spark, f"{path}/sums", _sums, ["group"])


def count_changes(fresh: DataFrame, last: DataFrame | None) -> DataFrame:
    """(group, delta): what the newest versions in ``fresh`` take away from and add to the groups that count records.

    Both sides: record, version, groups (sorted), one row per record.  Changes are added up
    per group before they meet.
    """
    if last is None:
        moved = fresh.withColumn("_old", F.array().cast("array<string>"))
    else:
        known = last.select("record", F.struct("version", "groups").alias("_known"))
        met = fresh.join(known, "record", "left").where("_known is null or struct(version, groups) > _known")
        moved = met.withColumn("_old", F.coalesce("_known.groups", F.array().cast("array<string>")))
    signed = F.concat(
        F.transform("groups", lambda g: F.struct(g.alias("group"), F.lit(1).cast("bigint").alias("delta"))),
        F.transform("_old", lambda g: F.struct(g.alias("group"), F.lit(-1).cast("bigint").alias("delta"))),
    )
    changes = moved.select(F.inline(signed))
    return changes.groupBy("group").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def count_batch(spark: SparkSession, path: str, record: str, version: str, groups: str, **options) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: keeps ``path/records`` (last version of each record) and ``path/sums``.

    ``groups``: the groups that count a record, an array of texts; null or empty retracts
    it.  Only a newer version changes anything.  Rows without a record or version count for
    nothing.  A batch reads the ranges of its own records, as they were before it, and both
    tables hold it once: repeated after a crash it adds nothing twice.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        records, sums = _tables(spark, path, **options)
        rows = batch.select(
            F.col(record).cast("string").alias("record"),
            F.col(version).cast("bigint").alias("version"),
            F.array_sort(F.coalesce(F.array_compact(F.col(groups)), F.array().cast("array<string>"))).alias("groups"),
            F.lit(batch_id).cast("bigint").alias("_seq"),
        )
        fresh = _newest(rows.where("record is not null and version is not null")).drop("_seq").persist()
        sums.append(count_changes(fresh, records.read(fresh, before=batch_id)), batch_id)
        records.append(fresh, batch_id)
        fresh.unpersist()

    return run


def keep_sums(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    trigger = trigger or {"availableNow": True}
    return stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current_sums(spark: SparkSession, path: str) -> DataFrame:
    """(group, n) of the groups that count any record now."""
    sums = _tables(spark, path)[1].read()
    sums = spark.createDataFrame([], "group string, delta bigint") if sums is None else sums
    return sums.where("delta <> 0").select("group", F.col("delta").alias("n"))


def status_groups(stages: Sequence[str] = ("pre", "mid", "post"), watershed: str = "mws_id", band: str = "band") -> Column:
    """The groups of a record in the backlog (stage and status) and in the bands of its watershed."""
    counted = [F.concat(F.lit(f"stage|{s}|"), F.col(f"{s}_slug")) for s in stages]
    counted += [F.concat(F.lit("band|"), F.col(watershed), F.lit("|"), F.coalesce(F.col(band), F.lit("unscored")))]
    return F.array_compact(F.array(*counted))


def split_group(counts: DataFrame) -> DataFrame:
    """(kind, name, value, n) of the groups made by ``status_groups``."""
    parts = F.split("group", r"\|")
    return counts.select(parts[0].alias("kind"), parts[1].alias("name"), parts[2].alias("value"), "n")
