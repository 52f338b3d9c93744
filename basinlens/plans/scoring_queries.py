"""Photo match, JSON recovery, evidence scores, evaluation, review order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinlens import constants as C
from basinlens.operators import evaluation, ranking, scoring, visual
from basinlens.plans.catalogue import q6, query, r6
from basinlens.plans.record_queries import SCORED, VISUAL, scored_records
from basinlens.plans.tables import Tables

GATED = "(confidence<0.6 or matches_declared='uncertain')"


@query("visual_score", f"select record_id, {VISUAL} visual_score from a_ai")
def visual_score(t: Tables) -> DataFrame:
    return t.ai.select("record_id", visual.visual_score().alias("visual_score"))


@query("review_gate", f"select record_id, {GATED} needs_review from a_ai")
def review_gate(t: Tables) -> DataFrame:
    return t.ai.select("record_id", visual.needs_review().alias("needs_review"))


FLAGS = """concat(case when matches_declared='no' then 'activity_mismatch' else '' end, case when matches_declared='no' and confidence<0.6 then ',' else '' end,
  case when matches_declared='uncertain' then 'uncertain_match_review' when confidence<0.6 then 'low_confidence_review' else '' end)"""


@query("review_flags", f"select record_id, {FLAGS} flags from a_ai")
def review_flags(t: Tables) -> DataFrame:
    return t.ai.select("record_id", F.array_join(visual.review_flags(), ",").alias("flags"))


ERRORS = """case kind when 'truncated' then 'not a JSON object; predicted_category is not an allowed value; predicted_activity must have 1 to 200 characters; construction_stage is not an allowed value; water_visible is not an allowed value; vegetation_cover is not an allowed value; matches_declared is not an allowed value; confidence must lie in 0 to 1; evidence must have 1 to 500 characters'
  when 'enum' then 'construction_stage is not an allowed value' when 'extra' then 'unexpected fields: mood' when 'range' then 'confidence must lie in 0 to 1'
  when 'blank' then 'evidence must have 1 to 500 characters' else '' end"""


@query("response_schema_check", f"select record_id, {ERRORS} errors from a_raw")
def response_schema_check(t: Tables) -> DataFrame:
    return visual.check_responses(t.raw).select("record_id", F.array_join("response_errors", "; ").alias("errors"))


@query(
    "validate_or_degrade",
    f"""select a.record_id, case when kind in ('ok','blank') then a.matches_declared else 'uncertain' end matches_declared,
   case when kind in ('ok','blank') then a.confidence else 0e0 end confidence,
   case when kind='ok' then 'pond with water' when kind='blank' then '(model did not provide a text justification for this classification)'
     else substr(concat('Classifier response invalid after 2 attempt(s): ', {ERRORS}), 1, 448) end evidence,
   case when kind in ('ok','blank') then {VISUAL} else 10 end visual_score,
   case when kind in ('ok','blank') then {GATED} else true end needs_review
   from a_ai a join a_raw r on a.record_id=r.record_id""",
)
def validate_or_degrade(t: Tables) -> DataFrame:
    out = visual.validate_or_degrade(t.raw, fill_evidence=True)
    return out.select(
        "record_id", "result.matches_declared", "result.confidence", "result.evidence", "visual_score", "needs_review"
    )


def model_answers(t: Tables) -> DataFrame:
    """Conversation turns as a local model would return them: bare, fenced, in prose, in a list, cut off, or plain."""
    kind = (F.col("conv_id") + F.col("turn")) % 6
    j = F.to_json(F.struct(F.col("turn").alias("n"), F.struct(F.col("text").alias("inner")).alias("evidence")))
    answer = (
        F.when(kind == 0, F.concat(F.lit(" \n"), j))
        .when(kind == 1, F.concat(F.lit("Here it is:\n```JSON\n"), j, F.lit("\n```\nDone {ok}.")))
        .when(kind == 2, F.concat(F.lit("Sure! "), j, F.lit(" hope {this} helps")))
        .when(kind == 3, F.concat(F.lit("["), j, F.lit("]")))
        .when(kind == 4, F.expr("substring(j, 1, length(j) - 1)"))
        .otherwise(F.col("text"))
    )
    return t.base("conversations").withColumn("j", j).withColumn("answer", answer)


@query(
    "json_recovery",
    """select conv_id, turn, (conv_id+turn)%6 < 4 recovered, case when (conv_id+turn)%6 < 4 then turn end n,
   case when (conv_id+turn)%6 < 4 then md5(text) end evidence_md5 from conversations""",
)
def json_recovery(t: Tables) -> DataFrame:
    found = model_answers(t).withColumn("found", visual.extract_json_object("answer"))
    return found.select(
        "conv_id",
        "turn",
        F.col("found").isNotNull().alias("recovered"),
        F.get_json_object("found", "$.n").cast("bigint").alias("n"),
        F.md5(F.get_json_object("found", "$.evidence.inner").cast("binary")).alias("evidence_md5"),
    )


def photo_manifest(t: Tables) -> DataFrame:
    return t.eval.select(
        F.col("doc_id").alias("record_id"),
        F.coalesce("pred", F.lit("OM")).alias("declared_category"),
        F.concat(F.lit("work "), F.col("model")).alias("declared_activity"),
        F.when(F.col("gt") != "NONE", F.col("gt")).alias("ground_truth_category"),
    )


def photo_judge():
    """A provider for the query: answers by rule, wrongly formed on the first attempt for every fifth record."""
    import json

    def respond(row: dict) -> str:
        if row["record_id"] % 5 == 0 and row["attempt"] == 1:
            return '{"confidence": "high"}'
        if row["record_id"] % 35 == 7:
            raise RuntimeError("no answer")
        agrees = row["ground_truth_category"] in (None, row["declared_category"])
        answer = {"predicted_category": row["ground_truth_category"] or row["declared_category"], "confidence": 0.75}
        answer |= {"predicted_activity": "seen work", "construction_stage": "unclear", "water_visible": "unclear", "vegetation_cover": "unclear"}
        return json.dumps(answer | {"matches_declared": "yes" if agrees else "no", "evidence": "stated by rule"})

    return respond


@query(
    "batch_classification",
    """select doc_id record_id, coalesce(pred,'OM') declared_category, case when doc_id%35=7 then 'UNKNOWN' else coalesce(nullif(gt,'NONE'), pred, 'OM') end predicted_category,
   cast(case when doc_id%5=0 or doc_id%35=7 then 2 else 1 end as int) attempts, case when doc_id%35=7 then 'no answer' end error,
   case when doc_id%35=7 then 10 when coalesce(nullif(gt,'NONE'), pred, 'OM') = coalesce(pred,'OM') then 30 else 0 end visual_score,
   doc_id%35<>7 and coalesce(nullif(gt,'NONE'), pred, 'OM') <> coalesce(pred,'OM') flagged from a_eval""",
)
def batch_classification(t: Tables) -> DataFrame:
    answered = visual.classify(photo_manifest(t), photo_judge)
    scored = visual.validate_or_degrade(answered)
    return scored.select(
        "record_id",
        "declared_category",
        "result.predicted_category",
        "attempts",
        "error",
        "visual_score",
        F.array_contains("review_flags", "activity_mismatch").alias("flagged"),
    )


# --- evidence score -----------------------------------------------------------------------

DID = "((record_id*31)%400-200)/1000e0"
SAT = f"""sat as (select record_id, category, v, case when category in ('LS','LH','OM') then 15 else
   case when v>=strong then 30 when v>=weak then 18 when v<=-weak then 0 else 10 end end satellite_score,
   case when category in ('LS','LH','OM') then 'not_applicable' when v>=strong then 'strongly_positive' when v>=weak then 'weakly_positive' when v<=-weak then 'negative' else 'inconclusive' end did_class, idx
  from (select record_id, category, case when category in ('LS','LH','OM') then null when category in ('PT','NC','SM') then case when record_id%6=0 then 'MNDWI' else 'water_fraction' end when category='BN' then 'NDVI_NDMI_MEAN' else 'NDVI' end idx,
    case when category in ('LS','LH','OM') then null when category in ('PT','NC','SM') then case when record_id%6=0 then {DID}/2 else {DID}*1.5e0 end when category='BN' then ({DID}+{DID}/4)/2 else {DID} end v,
    case when category in ('PT','NC','SM') then case when record_id%6=0 then 0.05e0 else 0.15e0 end else 0.08e0 end strong,
    case when category in ('PT','NC','SM') then case when record_id%6=0 then 0.015e0 else 0.05e0 end else 0.02e0 end weak from a_records))"""


def did_columns(df: DataFrame) -> DataFrame:
    d = ((F.col("record_id") * 31) % 400 - 200) / F.lit(1000.0)
    return df.withColumns(
        {"did_ndvi": d, "did_mndwi": d / 2, "did_ndmi": d / 4, "did_water_fraction": F.when(F.col("record_id") % 6 != 0, d * 1.5)}
    )


@query("did_class", f"with {SAT} select record_id, idx, did_class from sat where idx is not null")
def did_class(t: Tables) -> DataFrame:
    out = scoring.satellite_score(did_columns(t.records.select("record_id", "category"))).where("primary_index is not null")
    return out.select("record_id", F.col("primary_index").alias("idx"), scoring.classify_did("primary_index", "primary_did").alias("did_class"))


@query(
    "satellite_score",
    f"with {SAT} select record_id, category, idx primary_index, {q6('v')} primary_did, did_class, satellite_score, did_class='negative' or did_class='not_applicable' has_note from sat",
)
def satellite_score(t: Tables) -> DataFrame:
    out = scoring.satellite_score(did_columns(t.records.select("record_id", "category")))
    return out.select(
        "record_id", "category", "primary_index", r6("primary_did").alias("primary_did"), "did_class", "satellite_score",
        F.col("satellite_note").isNotNull().alias("has_note"),
    )


def evidence(t: Tables) -> DataFrame:
    """All four parts per record; temporal evidence exists for two records in three."""
    geo = scored_records(t).select("record_id", "mws_id", "category", "activity", "geo_flags", "geo_score")
    ai = t.ai.withColumn("visual_score", visual.visual_score()).withColumn("needs_review", visual.needs_review())
    temporal = F.when(F.col("record_id") % 3 == 0, 5).when(F.col("record_id") % 3 == 1, 10)
    full = scoring.satellite_score(did_columns(geo)).join(ai, "record_id", "left").withColumn("temporal_score", temporal)
    full = full.withColumn("evidence_score", scoring.evidence_score())
    return full.withColumn("band", scoring.evidence_band())


EVID = f"""{SCORED}, {SAT}, ev as (select sc.record_id, sc.mws_id, p_gps+p_inside+p_exif+p_dup+p_time geo_score, {VISUAL} visual_score, satellite_score,
   case record_id%3 when 0 then 5 when 1 then 10 end temporal_score, {GATED} needs_review
   from sc join sat using (record_id) join a_ai using (record_id)),
  banded as (select *, geo_score+visual_score+satellite_score+temporal_score evidence_score,
   case when geo_score+visual_score+satellite_score+temporal_score is null then null when geo_score+visual_score+satellite_score+temporal_score>=70 and not needs_review then 'verified'
     when geo_score+visual_score+satellite_score+temporal_score>=40 then 'review' else 'flag' end band from ev)"""


@query(
    "evidence_scores",
    f"with {EVID} select record_id, geo_score, visual_score, satellite_score, temporal_score, evidence_score, needs_review, band from banded",
)
def evidence_scores(t: Tables) -> DataFrame:
    return evidence(t).select(
        "record_id", "geo_score", "visual_score", "satellite_score", "temporal_score", "evidence_score", "needs_review", "band"
    )


@query(
    "band_stats",
    f"""with {EVID} select r.mws_id, count(*) total_assets, count(case when band='verified' then 1 end) verified, count(case when band='review' then 1 end) review, count(case when band='flag' then 1 end) flag,
   count(*)-count(case when band='verified' then 1 end)-count(case when band='review' then 1 end)-count(case when band='flag' then 1 end) unscored from a_records r left join banded using (record_id) group by 1""",
)
def band_stats(t: Tables) -> DataFrame:
    return scoring.band_stats(t.records, evidence(t).select("record_id", "band"))


@query(
    "review_queue",
    f"""with {EVID} select record_id, geo_score, needs_review, row_number() over (order by case when needs_review then 0 else 1 end, coalesce(geo_score,30), record_id) queue_pos
   from (select r.record_id, case when r.record_id%10=0 then null else geo_score end geo_score, case when r.record_id%7=0 then null else needs_review end needs_review from a_records r join ev using (record_id))""",
)
def review_queue(t: Tables) -> DataFrame:
    k = F.col("record_id")
    geo = scored_records(t).select("record_id", F.when(k % 10 != 0, F.col("geo_score")).alias("geo_score"))
    ai = t.ai.select("record_id", F.when(k % 7 != 0, visual.needs_review()).alias("needs_review"))
    return ranking.review_queue(geo.join(ai, "record_id", "left"))


@query(
    "temporal_scores",
    """with p as (select asset_id, ts, case stage when 'not_started' then 0 when 'under_construction' then 1 else 2 end s from a_stage where stage in ('not_started','under_construction','completed')),
   o as (select *, lag(s) over (partition by asset_id order by ts, s) prev from p)
   select asset_id, count(*) n_points, case when count(distinct ts)=1 then 5 when max(case when s<prev then 1 else 0 end)=0 and count(distinct s)>1 then 10 else 0 end temporal_score from o group by 1""",
)
def temporal_scores(t: Tables) -> DataFrame:
    return scoring.temporal_score(t.stage)


@query(
    "stage_progress_by_day",
    """with p as (select asset_id*100+day(ts) asset_id, ts, case stage when 'not_started' then 0 when 'under_construction' then 1 else 2 end s from a_stage where stage in ('not_started','under_construction','completed')),
   o as (select *, lag(s) over (partition by asset_id order by ts, s) prev from p)
   select asset_id, count(*) n_points, case when count(distinct ts)=1 then 5 when max(case when s<prev then 1 else 0 end)=0 and count(distinct s)>1 then 10 else 0 end temporal_score from o group by 1""",
)
def stage_progress_by_day(t: Tables) -> DataFrame:
    """The same rule on shorter histories, where all three outcomes occur."""
    return scoring.temporal_score(t.stage.withColumn("asset_id", F.col("asset_id") * 100 + F.dayofmonth("ts")))


@query(
    "outcome_index",
    f"""with {EVID}, st as (select mws_id, count(*) total_assets, count(case when band='verified' then 1 end) verified, sum({DID}*(1+record_id%5))/sum(1+record_id%5) ndvi_did, avg({DID}/2) water_change
     from banded group by 1)
   select mws_id, {q6("0.5e0*(ndvi_did-min(ndvi_did) over ())/(max(ndvi_did) over ()-min(ndvi_did) over ())+0.3e0*(water_change-min(water_change) over ())/(max(water_change) over ()-min(water_change) over ())+0.2e0*verified/total_assets")} outcome_index from st""",
)
def outcome_index(t: Tables) -> DataFrame:
    ev = evidence(t).withColumn("area", (1 + F.col("record_id") % 5).cast("double"))
    per = ev.groupBy("mws_id").agg(
        F.count(F.lit(1)).alias("total_assets"),
        F.count_if(F.col("band") == "verified").alias("verified"),
        F.try_divide(F.sum(F.col("did_ndvi") * F.col("area")), F.sum("area")).alias("ndvi_did"),
        F.avg("did_mndwi").alias("water_change"),
    )
    return scoring.outcome_index(per).select("mws_id", r6("outcome_index").alias("outcome_index"))


@query(
    "plain_reasons",
    f"""with {EVID} select b.record_id, case when band is null then 'Not yet scored — some sub-scores are still pending.' when band='verified' then concat('Verified — evidence score ', evidence_score, '/100. This is a triage signal, not a final verdict.')
     when band='review' then concat('Needs review — evidence score ', evidence_score, '/100.') else concat('Flagged for field inspection — evidence score ', evidence_score, '/100.') end headline,
   case when geo_score=30 then 'Geo-integrity checks all passed (30/30).' else concat('Geo-integrity scored ', geo_score, '/30 — failed: ',
      concat_ws(', ', case when p_gps<8 then 'gps accuracy' end, case when p_inside<8 then 'inside boundary' end, case when p_exif<6 then 'exif consistency' end, case when p_dup<5 then 'duplicate photo' end, case when p_time<3 then 'timestamp sane' end), '.') end geo_text,
   case matches_declared when 'yes' then concat('The AI photo check found the image consistent with the declared "', activity, '" activity (confidence ', (record_id*7)%101, '%).')
     when 'uncertain' then concat('The AI photo check was uncertain whether the image matches "', activity, '" — routed to human review.')
     else concat('The AI photo check found the image does not match the declared "', activity, '" activity.') end visual_text,
   case did_class when 'strongly_positive' then concat('Satellite imagery shows a strong positive change matching what "', activity, '" should produce on the ground (30/30).')
     when 'weakly_positive' then 'Satellite imagery shows a weak positive change (18/30).' when 'inconclusive' then 'Satellite change is close to zero / inconclusive (10/30).'
     when 'negative' then 'Satellite imagery shows a decline relative to the control area (0/30).' else 'No reliable satellite signal is expected for this category, so the satellite score is a neutral 15/30.' end satellite_text,
   2+1+case when temporal_score is null then 0 else 1 end n_sentences
   from banded b join sc using (record_id) join sat using (record_id) join a_ai using (record_id) join a_records r using (record_id)""",
)
def plain_reasons(t: Tables) -> DataFrame:
    sentences = [scoring.geo_sentence(), scoring.visual_sentence(), scoring.satellite_sentence(), scoring.temporal_sentence()]
    ev = evidence(t).withColumn("sentences", scoring.reason_sentences(*sentences))
    return ev.select(
        "record_id",
        scoring.headline().alias("headline"),
        F.col("sentences")[0].alias("geo_text"),
        F.col("sentences")[1].alias("visual_text"),
        F.col("sentences")[2].alias("satellite_text"),
        F.size("sentences").alias("n_sentences"),
    )


# --- evaluation -----------------------------------------------------------------------------

_AXIS = "case when gt='NONE' then 'UNKNOWN' else gt end"


@query("confusion_counts", f"select {_AXIS} gt, pred, count(*) n from a_eval where pred is not null group by 1,2")
def confusion_counts(t: Tables) -> DataFrame:
    return evaluation.confusion_counts(t.eval)


_CODES = [*C.CATEGORY_CODES, "UNKNOWN"]


@query(
    "confusion_matrix",
    "select " + _AXIS + " gt, " + ", ".join(f"count(case when pred='{c}' then 1 end) \"{c}\"" for c in _CODES) + " from a_eval where pred is not null group by 1",
)
def confusion_matrix(t: Tables) -> DataFrame:
    return evaluation.confusion_matrix(t.eval)


_SUMMARY = f"""select model, count(*) n_photos, count(case when {_AXIS}=pred then 1 end) n_correct, count(case when error is not null then 1 end) n_errors,
   count(case when evidence like 'Classifier response invalid%' then 1 end) n_schema_invalid_responses, round_even(count(case when {_AXIS}=pred then 1 end)/count(*), 4) accuracy from a_eval group by 1"""


@query("accuracy_summary", _SUMMARY)
def accuracy_summary(t: Tables) -> DataFrame:
    return evaluation.accuracy_summary(t.eval, ["model"])


@query(
    "accuracy_status",
    f"""select model, n_photos, case when model=2 or n_schema_invalid_responses/n_photos>=0.5 then 'not_established' else 'measured' end accuracy_status
   from (select model, n_photos, case when model=1 then n_photos else n_schema_invalid_responses end n_schema_invalid_responses from ({_SUMMARY}))""",
)
def accuracy_status(t: Tables) -> DataFrame:
    s = evaluation.accuracy_summary(t.eval, ["model"])
    s = s.withColumn("is_full_dataset", F.when(F.col("model") == 2, False))
    s = s.withColumn("n_schema_invalid_responses", F.when(F.col("model") == 1, F.col("n_photos")).otherwise(F.col("n_schema_invalid_responses")))
    return s.select("model", "n_photos", evaluation.accuracy_status().alias("accuracy_status"))


@query(
    "class_coverage",
    """select count(*) n_photos, (select string_agg(gt, ',' order by gt) from (select distinct gt from a_eval where gt <> 'NONE')) covered, '' missing, true has_distractors
   from a_eval""",
)
def class_coverage(t: Tables) -> DataFrame:
    out = evaluation.class_coverage(t.eval)
    return out.select("n_photos", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"), "has_distractors")


@query("resume_unfinished", "select doc_id, gt from a_eval where doc_id%43<>0 and doc_id%3=0 and doc_id%2=1 or doc_id%3<>0 and doc_id%2=1")
def resume_unfinished(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    done = t.eval.select("doc_id", F.when(k % 2 == 0, F.col("pred")).alias("pred"), F.when((k % 43 == 0) & (k % 3 == 0) | (k % 2 == 0), "timeout").alias("error"))
    return evaluation.unfinished(t.eval.select("doc_id", "gt"), done, "doc_id")


@query(
    "stratified_sample",
    "select doc_id, gt from (select *, row_number() over (partition by gt order by doc_id) n from a_eval) where n<=5",
)
def stratified_sample(t: Tables) -> DataFrame:
    return ranking.first_per_class(t.eval.select("doc_id", "gt"), "gt", "doc_id", 5)
