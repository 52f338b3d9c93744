"""Streams over the test tables, run until the present input is used up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basinlens import constants as C
from basinlens.functions.geo import hash_from_halves
from basinlens.operators import registry, scoring
from basinlens.operators.visual import needs_review, visual_score
from basinlens.plans.catalogue import query
from basinlens.plans.record_queries import HASHES, NOW, SCORED, VISUAL
from basinlens.plans.registry_queries import slug
from basinlens.plans.scoring_queries import GATED
from basinlens.plans.tables import Tables
from basinlens.session import scratch_path
from basinlens.streaming import ingest, live_counts, photo_state


def table_stream(t: Tables, name: str) -> DataFrame:
    """A base table's file as a stream (a glob, since file streams watch folders)."""
    schema = t.base(name).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{name}*.parquet")


def in_columns(t: Tables, rows: DataFrame) -> DataFrame:
    """``rows`` written once by column: who looks for the cuts reads the key alone."""
    path = scratch_path(t.spark, "columns")
    rows.write.parquet(path)
    return t.spark.read.schema(rows.schema).parquet(path)


def in_parts(t: Tables, rows: DataFrame, key: str, parts: int, start: Callable[[DataFrame], StreamingQuery], spark: SparkSession | None = None) -> None:
    """``rows`` arrive in ``parts`` by ascending ``key``: the stream is started again on its checkpoint after each."""
    spark, folder = spark or t.spark, scratch_path(t.spark, "arriving")
    cuts = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = rows if low is None else rows.where(F.col(key) > low)
        part = part if high is None else part.where(F.col(key) <= high)
        part.write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


@query(
    "stream_ingest",
    f"with {SCORED} select record_id, mws_id, p_gps+p_inside+p_exif+p_dup+p_time geo_score from sc",
)
def stream_ingest(t: Tables) -> DataFrame:
    """Orders arrive as records; every batch is scored against all earlier photos."""
    out, checkpoint = scratch_path(t.spark, "ingest"), scratch_path(t.spark, "ingest-state")
    customers = t.base("customer")
    text = t.record_expressions()
    extra = {"is_synthetic": F.lit(False), "photo_source": F.lit(None).cast("string")}

    def photos_of(batch: DataFrame) -> DataFrame:
        return both_photos(batch, "record_id")

    expected = 2 * t.base("orders").count()
    body = ingest.ingest_batch(t.spark, t.mws, t.edges, photos_of, out, F.lit(NOW).cast("timestamp_ntz"), expected=expected)

    def start(orders: DataFrame) -> StreamingQuery:
        arriving = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        return ingest.start_ingest(arriving.selectExpr(*text).withColumns(extra), body, checkpoint)

    in_parts(t, t.base("orders"), "o_orderkey", 2, start)
    return ingest.current_records(t.spark, out).select("record_id", "mws_id", "geo_score")


def both_photos(rows: DataFrame, key: str) -> DataFrame:
    """record_id, phash of one or two photos per row (see the adapter ``a_photo_hex``)."""
    k = F.col(key)
    first = F.struct(
        F.when(k % 29 != 0, F.md5(F.floor(k / 3).cast("string").cast("binary"))).alias("base"),
        F.when(k % 3 == 0, 0).when(k % 3 == 1, 7).otherwise(127).alias("flip"),
    )
    second = F.struct(
        F.md5(F.concat(F.lit("p"), F.floor(k / 8).cast("string")).cast("binary")).alias("base"),
        F.when(k % 8 == 0, 0).otherwise(63).alias("flip"),
    )
    slots = F.array_compact(F.array(first, F.when(k % 4 == 0, second)))
    hexes = rows.select(k.alias("record_id"), F.inline(slots))
    high = F.conv(F.substring("base", 1, 8), 16, 10).cast("bigint").bitwiseXOR(F.col("flip").cast("bigint"))
    low = F.conv(F.substring("base", 9, 8), 16, 10).cast("bigint")
    return hexes.select("record_id", hash_from_halves(high, low).alias("phash"))


@query(
    "stream_duplicates",
    f"with {HASHES} select record_id, cast(min_distance as int) min_distance from dup",
)
def stream_duplicates(t: Tables) -> DataFrame:
    """Keyed state finds the near-duplicates of both photos of a record among all earlier ones."""
    out, checkpoint = scratch_path(t.spark, "dups"), scratch_path(t.spark, "dups-state")
    orders = t.base("orders").select("o_orderkey")
    expected = 2 * orders.count()

    def start(rows: DataFrame) -> StreamingQuery:
        photos = both_photos(rows, "o_orderkey").where("phash is not null")
        found = photo_state.stream_duplicates(photos, expected).writeStream.format("parquet")
        return found.option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    in_parts(t, orders, "o_orderkey", 2, start, photo_state.state_session(t.spark))
    return photo_state.least_distances(t.spark.read.schema(photo_state.OUTPUT).parquet(out))


_SLUGS = [("pre", "pre_status"), ("mid", "mid_status"), ("post", "post_status")]
_BAND = f"case when {VISUAL}+50 >= {C.VERIFIED_FROM} and not {GATED} then 'verified' when {VISUAL}+50 >= {C.REVIEW_FROM} then 'review' else 'flag' end"


@query(
    "stream_backlog",
    "with g as ("
    + " union all ".join(f"select 'stage' kind, '{stage}' name, {slug(status)} value from a_work" for stage, status in _SLUGS)
    + f""" union all select 'band', r.mws_id, {_BAND} from a_records r join a_ai a on r.record_id=a.record_id)
  select kind, name, value, count(*) n from g group by 1,2,3""",
)
def stream_backlog(t: Tables) -> DataFrame:
    """Works per stage and status and records per watershed and band, kept current while statuses change.

    A work arrives without statuses or band, then with them; of some an old version comes
    once more, which changes nothing.  Parts other than the photo score are taken as 50.
    """
    out, checkpoint = scratch_path(t.spark, "backlog"), scratch_path(t.spark, "backlog-state")
    work = t.work.select(F.substring("work_code", 2, 20).cast("bigint").alias("record_id"), *[c for _, c in _SLUGS])
    score = F.expr("visual_score + 50")
    now = t.records.select("record_id", "mws_id").join(work, "record_id").join(t.ai.withColumn("visual_score", visual_score()), "record_id")
    now = now.withColumn("band", scoring.evidence_band(score, needs_review()))
    k = F.col("record_id")
    versions = F.array(F.lit(1), F.lit(2))
    rows = now.select("*", F.explode(F.when(k % 5 == 0, F.array_append(versions, F.lit(0))).otherwise(versions)).alias("version"))
    # first sights in the first half of the arrivals, scored ones in the second; version 0 comes last of all
    rows = rows.withColumn("arrival", F.when(F.col("version") == 1, 1).when(F.col("version") == 2, 2).otherwise(3))
    for stage, status in _SLUGS:
        # slugs of fixed texts are constants: a record's own text is looked at once, not in each version
        fixed = F.when(F.col("version") == 0, registry.status_slug(F.lit("Rejected"))).otherwise(registry.status_slug(F.lit("")))
        rows = rows.withColumn(f"{stage}_slug", F.when(F.col("version") == 2, registry.status_slug(F.col(status))).otherwise(fixed))
    rows = rows.withColumn("band", F.when(F.col("version") == 2, F.col("band")))
    rows = rows.select("record_id", "version", "arrival", live_counts.status_groups().alias("groups"))

    def start(stream: DataFrame) -> StreamingQuery:
        return live_counts.keep_sums(stream, live_counts.count_batch(t.spark, out, "record_id", "version", "groups"), checkpoint)

    in_parts(t, in_columns(t, rows), "arrival", 3, start)
    return live_counts.split_group(live_counts.current_sums(t.spark, out))


@query(
    "stream_daily_counts",
    "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) n from events group by 1,2",
)
def stream_daily_counts(t: Tables) -> DataFrame:
    """Daily counts per status kept current by a watermarked stream."""
    out, checkpoint = scratch_path(t.spark, "daily"), scratch_path(t.spark, "daily-state")
    counts = live_counts.windowed_counts(table_stream(t, "events"), ["event_type"])
    live_counts.keep_latest(counts, out, checkpoint, ["event_type"]).awaitTermination()
    current = live_counts.current_counts(t.spark.read.parquet(out), ["event_type"])
    return current.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")
