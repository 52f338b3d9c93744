"""Candidate ranking, control matching, review queue, stratified samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basinlens import constants as C
from basinlens.operators.common import attach_scalars, global_row_number, latest_by_key
from basinlens.session import cut_lineage


def exclusion_reason() -> Column:
    """First rule a candidate breaks, as text; null when it is eligible."""

    def over(name: str, sign: str, limit: float, label: str, digits: int) -> Column:
        return F.concat(
            F.lit(f"{name} "), F.format_string(f"%.{digits}f", F.col(name)), F.lit(f" {sign} {label} {limit}")
        )

    return (
        F.when(F.col("pixel_count") <= 0, F.lit(C.NO_PIXELS_REASON))
        .when(F.col("area_ha") < C.MIN_AREA_HA, over("area_ha", "<", C.MIN_AREA_HA, "MIN_AREA_HA", 1))
        .when(F.col("area_ha") > C.MAX_AREA_HA, over("area_ha", ">", C.MAX_AREA_HA, "MAX_AREA_HA", 1))
        .when(
            F.col("built_up_share") > C.MAX_BUILT_SHARE,
            over("built_up_share", ">", C.MAX_BUILT_SHARE, "MAX_BUILT_UP_SHARE", 3),
        )
        .when(
            F.col("water_share") > C.MAX_WATER_SHARE,
            over("water_share", ">", C.MAX_WATER_SHARE, "MAX_WATER_SHARE", 3),
        )
    )


def composite_score() -> Column:
    return (
        F.lit(C.WEIGHT_CROP) * F.col("crop_share")
        + F.lit(C.WEIGHT_LOW_BUILT) * (F.lit(1.0) - F.col("built_up_share"))
        + F.lit(C.WEIGHT_LOW_WATER) * (F.lit(1.0) - F.col("water_share"))
    )


def in_preferred_slope_band(slope="mean_slope_deg") -> Column:
    col = F.col(slope) if isinstance(slope, str) else slope
    return col.between(*C.SLOPE_BAND_DEG)


def score_candidates(candidates: DataFrame) -> DataFrame:
    return (
        candidates.withColumn("composite_score", composite_score())
        .withColumn("exclusion_reason", exclusion_reason())
        .withColumn("excluded", F.col("exclusion_reason").isNotNull())
        .withColumn("in_slope_band", in_preferred_slope_band())
    )


def rank_candidates(candidates: DataFrame, position: str = "pos") -> DataFrame:
    """All candidates with score and reason; eligible ones also with ``rank`` (ties by input position)."""
    scored = cut_lineage(score_candidates(candidates))  # one row per polygon, read twice
    eligible = global_row_number(scored.where("not excluded"), [F.desc("composite_score"), F.asc(position)], "rank")
    return eligible.unionByName(scored.where("excluded").withColumn("rank", F.lit(None).cast("long")))


def select_treated(scored: DataFrame, k: int, position: str = "pos") -> DataFrame:
    """The ``k`` best eligible candidates: a top-k, no full sort or numbering of the rest."""
    return scored.where("not excluded").orderBy(F.desc("composite_score"), F.asc(position)).limit(k)


def match_controls(
    treated: DataFrame, pool: DataFrame, key: str = "polygon_id", ndvi_tolerance: float | None = None
) -> DataFrame:
    """Eligible pool members close to the treated means in crop share and slope.

    A missing slope on either side leaves that test out.  ``ndvi_tolerance`` turns on
    the third criterion, for inputs that carry a ``ndvi`` column.
    """
    stats = [F.avg("crop_share").alias("_crop"), F.avg("mean_slope_deg").alias("_slope")]
    if ndvi_tolerance is not None:
        stats.append(F.avg("ndvi").alias("_ndvi"))
    means = treated.agg(*stats)
    others = pool.where("not excluded").join(treated.select(key), key, "left_anti")
    with_means = attach_scalars(others, means)

    def near(value: str, mean: str, tolerance: float) -> Column:
        gap = F.try_divide(F.abs(F.col(value) - F.col(mean)), F.col(mean))
        return F.coalesce((F.col(mean) > 0) & (gap <= tolerance), F.lit(False))

    slope_known = F.col("_slope").isNotNull() & F.col("mean_slope_deg").isNotNull()
    slope_ok = F.abs(F.col("mean_slope_deg") - F.col("_slope")) <= C.SLOPE_TOLERANCE_DEG
    kept = with_means.where(near("crop_share", "_crop", C.CROP_TOLERANCE) & (~slope_known | slope_ok))
    ndvi_match = F.lit(C.NDVI_PENDING)
    if ndvi_tolerance is not None:
        kept = kept.where(near("ndvi", "_ndvi", ndvi_tolerance))
        ndvi_match = F.lit("true")
    return kept.select(
        *others.columns,
        F.lit(True).alias("crop_share_match"),
        F.when(slope_known, F.lit("true")).otherwise(F.lit(C.SLOPE_NOT_EVALUATED)).alias("slope_match"),
        ndvi_match.alias("ndvi_match"),
    )


def select_study_sets(
    scored: DataFrame, treated_district: str, k: int, key: str = "polygon_id", position: str = "pos"
) -> tuple[DataFrame, DataFrame]:
    """(treated, controls): the best ``k`` inside the district, controls only from other districts."""
    scored = cut_lineage(scored)  # one row per polygon, read several times
    treated = select_treated(scored.where(F.col("district") == treated_district), k, position)
    pool = scored.where(F.col("district").isNull() | (F.col("district") != treated_district))
    return treated, match_controls(treated, pool, key)


def review_order(key: str = "record_id") -> list[Column]:
    """Gated records first, then the lowest geo-score (missing counts as 30), then the id."""
    gated = F.when(F.coalesce(F.col("needs_review"), F.lit(False)), 0).otherwise(1)
    return [gated.asc(), F.coalesce(F.col("geo_score"), F.lit(30)).asc(), F.col(key).asc()]


def review_queue(assets: DataFrame, key: str = "record_id") -> DataFrame:
    """All assets with their place in the moderation queue."""
    return global_row_number(assets, review_order(key), "queue_pos")


def first_per_class(df: DataFrame, group: str, position: str, n: int) -> DataFrame:
    """First ``n`` rows of each class in input order.

    Spark applies the row-number limit before the shuffle too, so at most ``n`` rows
    per class leave each task.
    """
    w = W.partitionBy(group).orderBy(position)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def latest_decisions(reviews: DataFrame, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """Newest confirmed/rejected decision per asset (ties on time go to the larger review id)."""
    final = reviews.where(F.col("decision").isin("confirmed", "rejected"))
    return latest_by_key(final, list(keys), ["reviewed_at", "review_id"])
