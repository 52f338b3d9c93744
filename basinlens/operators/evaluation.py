"""Classifier evaluation: confusion matrix, accuracy and how far to trust it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinlens import constants as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truth_axis(code) -> Column:
    """Ground truth NONE and prediction UNKNOWN are the same place on the axis."""
    c = _col(code)
    return F.when(c == C.NONE_CODE, F.lit(C.UNKNOWN_CODE)).otherwise(c)


def confusion_counts(results: DataFrame) -> DataFrame:
    """(gt, pred, n) of the rows that have a prediction.  ``results``: gt, pred."""
    return (
        results.where("pred is not null")
        .groupBy(truth_axis("gt").alias("gt"), "pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_matrix(results: DataFrame) -> DataFrame:
    """Wide form, one column per code; the codes are given, so no extra pass to find them."""
    axis = [*C.CATEGORY_CODES, C.UNKNOWN_CODE]
    counts = confusion_counts(results).groupBy("gt").pivot("pred", axis).agg(F.sum("n"))
    return counts.select("gt", *[F.coalesce(F.col(a), F.lit(0)).alias(a) for a in axis])


def accuracy_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy over all rows, errors and invalid responses.  ``results``: gt, pred, error, evidence."""
    has = set(results.columns)
    error = F.col("error").isNotNull() if "error" in has else F.lit(False)
    invalid = F.col("evidence").startswith(C.INVALID_EVIDENCE_PREFIX) if "evidence" in has else F.lit(False)
    counts = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_photos"),
        F.count_if(truth_axis("gt") == F.col("pred")).alias("n_correct"),
        F.count_if(error).alias("n_errors"),
        F.count_if(invalid).alias("n_schema_invalid_responses"),
    )
    share = F.try_divide(F.col("n_correct").cast("double"), F.col("n_photos"))
    return counts.withColumn("accuracy", F.coalesce(F.bround(share, 4), F.lit(0.0)))


def accuracy_status(photos="n_photos", full="is_full_dataset", invalid="n_schema_invalid_responses") -> Column:
    """``measured`` only for a full run whose responses mostly had the right form."""
    n, bad = F.coalesce(_col(photos), F.lit(0)), F.coalesce(_col(invalid), F.lit(0))
    whole = F.coalesce(_col(full), F.lit(True))
    mostly_bad = F.coalesce(F.try_divide(bad.cast("double"), n) >= C.INVALID_SHARE_LIMIT, F.lit(False))
    return F.when((n == 0) | ~whole | mostly_bad, "not_established").otherwise("measured")


def class_coverage(manifest: DataFrame, truth: str = "gt") -> DataFrame:
    """One row: classes present, classes missing, whether distractors are present."""
    seen = F.collect_set(truth)  # at most one entry per code
    codes = F.array(*[F.lit(c) for c in C.CATEGORY_CODES])
    row = manifest.agg(F.count(F.lit(1)).alias("n_photos"), seen.alias("_seen"))
    covered = F.array_sort(F.array_remove("_seen", C.NONE_CODE))
    return row.select(
        "n_photos",
        covered.alias("covered"),
        F.array_sort(F.array_except(codes, covered)).alias("missing"),
        F.array_contains("_seen", C.NONE_CODE).alias("has_distractors"),
    )


def unfinished(manifest: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to classify: those without a prediction or a recorded error."""
    finished = done.where("pred is not null or error is not null").select(key)
    return manifest.join(finished, key, "left_anti")
