"""Satellite and evidence scores, bands, stage progression, outcome index, plain-language reasons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinlens import constants as C
from basinlens.operators.common import attach_scalars


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(values: Mapping[str, object], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


# --- satellite response ---------------------------------------------------------------


def classify_did(index, value, thresholds: Mapping[str, tuple[float, float]] = C.DID_THRESHOLDS) -> Column:
    """Four-way class of an effect; null for an index without thresholds."""
    i, v = _col(index) if not isinstance(index, str) else F.col(index), _col(value)
    strong = _lookup({k: t[0] for k, t in thresholds.items()}, i)
    weak = _lookup({k: t[1] for k, t in thresholds.items()}, i)
    return F.when(strong.isNotNull() & v.isNotNull(), F.when(v >= strong, "strongly_positive")
        .when(v >= weak, "weakly_positive").when(v <= -weak, "negative").otherwise("inconclusive"))


def satellite_score(df: DataFrame, category: str = "category") -> DataFrame:
    """Adds primary index, its effect, class, score (0-30) and note.

    Effects are read from did_ndvi, did_mndwi, did_ndmi (missing counts as 0) and
    did_water_fraction; where the last is missing MNDWI and its thresholds stand in.
    Unknown categories get an ``error`` instead of a score.
    """
    code = F.upper(F.col(category))
    ndvi, mndwi, ndmi = (F.coalesce(F.col(f"did_{i}"), F.lit(0.0)) for i in ("ndvi", "mndwi", "ndmi"))
    water = F.col("did_water_fraction")
    planned = _lookup(C.PRIMARY_INDEX, code)
    index = F.when((planned == "water_fraction") & water.isNull(), F.lit("MNDWI")).otherwise(planned)
    value = (
        F.when(F.col("primary_index") == "NDVI_NDMI_MEAN", (ndvi + ndmi) / 2)
        .when(F.col("primary_index") == "water_fraction", water)
        .when(F.col("primary_index") == "MNDWI", mndwi)
        .when(F.col("primary_index") == "NDVI", ndvi)
    )
    silent = code.isin(C.NO_SIGNAL_CATEGORIES)
    known = code.isin(C.CATEGORY_CODES)
    did_class = F.when(silent, F.lit("not_applicable")).otherwise(classify_did("primary_index", "primary_did"))
    note = F.when(silent, F.format_string(C.NO_SIGNAL_NOTE, code)).when(
        F.col("did_class") == "negative", F.lit(C.NEGATIVE_NOTE)
    )
    return (
        df.withColumn("primary_index", index)
        .withColumn("primary_did", value)
        .withColumn("did_class", did_class)
        .withColumn(
            "satellite_score",
            F.when(silent, F.lit(C.NO_SIGNAL_POINTS)).otherwise(_lookup(C.DID_POINTS, F.col("did_class"))),
        )
        .withColumn("satellite_note", note)
        .withColumn("error", F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown category "), code)))
    )


# --- evidence score ---------------------------------------------------------------------


def evidence_score(geo="geo_score", visual="visual_score", satellite="satellite_score", temporal="temporal_score"):
    """Sum of the four parts; null while one is missing."""
    return _col(geo) + _col(visual) + _col(satellite) + _col(temporal)


def evidence_band(score="evidence_score", review="needs_review") -> Column:
    """Band of a score; a gated record is held at "review", never raised from "flag"."""
    s, gated = _col(score), F.coalesce(_col(review), F.lit(False))
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when((s >= C.VERIFIED_FROM) & ~gated, "verified")
        .when(s >= C.REVIEW_FROM, "review")
        .otherwise("flag")
    )


def band_stats(records: DataFrame, evidence: DataFrame, key: str = "mws_id", record: str = "record_id") -> DataFrame:
    """Assets per watershed and band; ``unscored`` is what no band accounts for."""
    joined = records.select(key, record).join(evidence.select(record, "band"), record, "left")
    counts = joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_assets"), *[F.count_if(F.col("band") == b).alias(b) for b in C.BANDS]
    )
    return counts.withColumn("unscored", F.col("total_assets") - F.col("verified") - F.col("review") - F.col("flag"))


def temporal_score(points: DataFrame, key: str = "asset_id") -> DataFrame:
    """Stage progression per asset (``points``: key, ts, stage).  Provisional rule.

    Only the three ordered stages count.  One point in time scores 5.  Stages that
    never go back and reach a later one score 10, anything else 0.

    "Never go back" means: the last sight of a stage is not after the first sight of a
    later stage.  That needs one minimum and maximum per stage, so the whole rule is a
    partial aggregation with no per-asset list or sort.
    """
    stages = C.ORDERED_STAGES
    aggs = []
    for i, s in enumerate(stages):
        at = F.when(F.col("stage") == s, F.col("ts"))
        aggs += [F.min(at).alias(f"_lo{i}"), F.max(at).alias(f"_hi{i}")]
    known = points.where(F.col("stage").isin(stages))
    wide = known.groupBy(key).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.count(F.lit(1)).alias("n_points"), *aggs)
    back = F.lit(False)
    for i in range(len(stages)):
        for j in range(i + 1, len(stages)):
            back = back | F.coalesce(F.col(f"_hi{i}") > F.col(f"_lo{j}"), F.lit(False))
    seen = sum((F.col(f"_lo{i}").isNotNull().cast("int") for i in range(1, len(stages))), F.col("_lo0").isNotNull().cast("int"))
    score = (
        F.when(F.col("_first") == F.col("_last"), C.TEMPORAL_SINGLE)
        .when(~back & (seen > 1), C.TEMPORAL_FULL)
        .otherwise(0)
    )
    return wide.select(key, "n_points", score.alias("temporal_score"))


def outcome_index(watersheds: DataFrame, weights: tuple[float, float, float] = C.OUTCOME_WEIGHTS) -> DataFrame:
    """Weighted index per watershed; the two effects are min-max scaled over all rows.  Provisional.

    ``watersheds``: mws_id, ndvi_did (area-weighted), water_change, verified, total_assets.
    """
    limits = watersheds.agg(
        F.min("ndvi_did").alias("_n0"), F.max("ndvi_did").alias("_n1"),
        F.min("water_change").alias("_w0"), F.max("water_change").alias("_w1"),
    )
    scaled = attach_scalars(watersheds, limits)

    def norm(value: str, low: str, high: str) -> Column:
        return F.coalesce(F.try_divide(F.col(value) - F.col(low), F.col(high) - F.col(low)), F.lit(0.0))

    a, b, c = weights
    share = F.coalesce(F.try_divide(F.col("verified").cast("double"), F.col("total_assets")), F.lit(0.0))
    index = F.lit(a) * norm("ndvi_did", "_n0", "_n1") + F.lit(b) * norm("water_change", "_w0", "_w1") + F.lit(c) * share
    return scaled.select(*watersheds.columns, index.alias("outcome_index"))


def area_weighted(df: DataFrame, key: str, value: str, area: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.try_divide(F.sum(F.col(value) * F.col(area)), F.sum(area)).alias(name))


# --- plain-language reasons -----------------------------------------------------------

# fixed values: sentence per satellite class; %1$d score, %2$s activity
SATELLITE_SENTENCES = {
    "strongly_positive": 'Satellite imagery shows a strong positive change matching what "%2$s" should produce on the ground (%1$d/30).',
    "weakly_positive": "Satellite imagery shows a weak positive change (%1$d/30).",
    "inconclusive": "Satellite change is close to zero / inconclusive (%1$d/30).",
    "negative": "Satellite imagery shows a decline relative to the control area (%1$d/30).",
    "not_applicable": "No reliable satellite signal is expected for this category, so the satellite score is a neutral %1$d/30.",
}
PLACEHOLDER_SENTENCE = "This reading is placeholder data (no real satellite imagery processed yet), not a real verdict."
# fixed values: photo-match sentences; %1$s activity, %2$d confidence percent
VISUAL_SENTENCES = {
    "yes": 'The AI photo check found the image consistent with the declared "%1$s" activity (confidence %2$d%%).',
    "uncertain": 'The AI photo check was uncertain whether the image matches "%1$s" — routed to human review.',
    "no": 'The AI photo check found the image does not match the declared "%1$s" activity.',
}
TEMPORAL_SINGLE_SENTENCE = (
    "Only one time point of photo evidence is available, so temporal consistency is scored neutral (5/10) rather than penalised."
)
# fixed values: headlines
HEADLINES = {
    "verified": "Verified — evidence score %d/100. This is a triage signal, not a final verdict.",
    "review": "Needs review — evidence score %d/100.",
    "flag": "Flagged for field inspection — evidence score %d/100.",
}
HEADLINE_PENDING = "Not yet scored — some sub-scores are still pending."


def geo_sentence(score="geo_score", flags="geo_flags") -> Column:
    s, f = _col(score), _col(flags)
    failed = F.filter(f, lambda x: ~x["passed"])
    names = F.array_join(F.transform(failed, lambda x: F.replace(x["rule"], F.lit("_"), F.lit(" "))), ", ")
    all_ok = F.format_string("Geo-integrity checks all passed (%d/30).", s)
    some = F.format_string("Geo-integrity scored %d/30 — failed: %s.", s, names)
    return F.when(s.isNotNull() & f.isNotNull(), F.when(F.size(failed) == 0, all_ok).otherwise(some))


def visual_sentence(score="visual_score", match="matches_declared", confidence="confidence", activity="activity") -> Column:
    m, a = _col(match), _col(activity)
    pct = F.floor(_col(confidence) * 100 + 0.5).cast("int")  # halves up
    texts = F.when(m == "yes", F.format_string(VISUAL_SENTENCES["yes"], a, pct))
    texts = texts.when(m == "uncertain", F.format_string(VISUAL_SENTENCES["uncertain"], a))
    texts = texts.when(m == "no", F.format_string(VISUAL_SENTENCES["no"], a))
    return F.when(_col(score).isNotNull(), texts)


def satellite_sentence(
    score="satellite_score", did_class="did_class", activity="activity", placeholder=None, note=None
) -> Column:
    s, a, k = _col(score), _col(activity), _col(did_class)
    main = None
    for name, text in SATELLITE_SENTENCES.items():
        line = F.format_string(text, s, a)
        main = F.when(k == name, line) if main is None else main.when(k == name, line)
    parts = [main]
    if placeholder is not None:
        parts.append(F.when(_col(placeholder), F.lit(PLACEHOLDER_SENTENCE)))
    if note is not None:
        parts.append(_col(note))
    return F.when(s.isNotNull() & k.isNotNull(), F.concat_ws(" ", *parts))


def temporal_sentence(score="temporal_score") -> Column:
    s = _col(score)
    return F.when(s == C.TEMPORAL_SINGLE, F.lit(TEMPORAL_SINGLE_SENTENCE)).when(
        s.isNotNull(),
        F.format_string("Temporal consistency scored %d/10 based on progression across multiple photos.", s),
    )


def reason_sentences(*sentences: Column) -> Column:
    return F.filter(F.array(*sentences), lambda x: x.isNotNull())


def headline(score="evidence_score", band="band") -> Column:
    s, b = _col(score), _col(band)
    out = F.when(s.isNull() | b.isNull(), F.lit(HEADLINE_PENDING))
    for name, text in HEADLINES.items():
        out = out.when(b == name, F.format_string(text, s))
    return out
