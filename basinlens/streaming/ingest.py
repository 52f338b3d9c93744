"""Continuous ingest: validate, score, and keep the photo history, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basinlens.operators.hash_index import HashIndex
from basinlens.operators.integrity import ingest
from basinlens.operators.photos import stored_hashes
from basinlens.operators.records import keyed_table, upsert_into


VERSION = ["batch_id", "created_at"]  # of two rows of a record the later one counts


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    # one folder per batch, replaced when the batch is repeated after a failure
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def ingest_batch(
    spark: SparkSession,
    watersheds: DataFrame,
    edges: DataFrame,
    photos_of: Callable[[DataFrame], DataFrame],
    out: str,
    now,
    blocks: int | None = None,
    expected: int = 10_000_000,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body.  Writes ``out/scored`` and ``out/quarantine``, a folder per batch.

    Also keeps ``out/records``, a keyed table of one row per record (see ``current_records``):
    a record sent again replaces its row, and of rows of one record in one batch the last
    ``created_at`` wins.  ``out/hashes`` is the index of all stored photos; a batch reads
    the ranges of its own keys there, as they were before it, so a repeated batch does not
    see its own output.  Photos stored by earlier batches count whatever their record's id
    is; within a batch a smaller id counts as stored before.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        index = HashIndex(spark, f"{out}/hashes", blocks, expected)
        photos = photos_of(batch)
        scored, rejected = ingest(batch, watersheds, edges, photos, now, index=index, before=batch_id)
        _write(scored, f"{out}/scored", batch_id)
        _write(rejected, f"{out}/quarantine", batch_id)
        written = spark.read.parquet(f"{out}/scored/batch_id={batch_id}")
        upsert_into(f"{out}/records", written.withColumn("batch_id", F.lit(batch_id)), ["record_id"], VERSION, batch_id)
        accepted = written.select("record_id")
        index.append(stored_hashes(photos.join(accepted, "record_id", "left_semi")), batch_id)
        batch.unpersist()

    return run


def current_records(spark: SparkSession, out: str) -> DataFrame | None:
    """One row per record of an ingest's output; None before the first batch."""
    return keyed_table(spark, f"{out}/records", ["record_id"], VERSION).read()


def start_ingest(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    trigger = trigger or {"availableNow": True}
    return stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(**trigger).start()
