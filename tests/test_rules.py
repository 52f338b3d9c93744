"""Hand cases at the edges of the scoring rules."""

import datetime as dt
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from basinlens import constants as C
from basinlens.functions import text
from basinlens.operators import coverage, evaluation, integrity, photos, ranking, registry, scoring, validate, visual


def one(spark, column, **values):
    schema = ", ".join(f"{k} {kind}" for k, (kind, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], schema)
    return df.select(column.alias("x")).first()["x"]


def column_of(spark, column, schema, rows):
    return [r["x"] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_gps_bands(spark):
    rows = [(10.0,), (10.01,), (25.0,), (25.01,), (None,)]
    flags = column_of(spark, integrity.gps_accuracy_flag(), "gps_accuracy_m double", rows)
    assert [f["points"] for f in flags] == [8, 4, 4, 0, 0]
    assert [f["passed"] for f in flags] == [True, False, False, False, False]
    assert flags[0]["detail"] == "10.0m <= 10.0m"
    assert flags[4]["detail"] == "gps_accuracy_m missing"


def test_exif_cases(spark):
    day, other = dt.date(2025, 2, 1), dt.datetime(2025, 2, 3)
    same = dt.datetime(2025, 2, 1, 9)
    schema = "lat double, lon double, captured_date date, exif_lat double, exif_lon double, exif_ts timestamp_ntz"
    rows = [
        (26.0, 92.0, day, 26.0, 92.0, same),
        (26.0, 92.0, day, 26.0, 92.0, other),
        (26.0, 92.0, day, 27.0, 92.0, other),
        (26.0, 92.0, day, 27.0, 92.0, None),
        (26.0, 92.0, day, None, None, other),
        (26.0, 92.0, None, 26.0, 92.0, same),
        (26.0, 92.0, day, None, None, None),
    ]
    flags = column_of(spark, integrity.exif_consistency_flag(), schema, rows)
    assert [f["points"] for f in flags] == [6, 3, 0, 3, 3, 3, 0]
    assert [f["passed"] for f in flags] == [True] + [False] * 6


def test_exif_tolerance_is_100_m(spark):
    schema = "lat double, lon double, captured_date date, exif_lat double, exif_lon double, exif_ts timestamp_ntz"
    day, ts = dt.date(2025, 2, 1), dt.datetime(2025, 2, 1)
    north = 100.0 / 6_371_000 * 180 / 3.141592653589793
    rows = [(26.0, 92.0, day, 26.0 + north * f, 92.0, ts) for f in (0.999, 1.001)]
    assert [f["points"] for f in column_of(spark, integrity.exif_consistency_flag(), schema, rows)] == [6, 3]


def test_timestamp_window(spark):
    schema = "captured_at timestamp_ntz, captured_date date, window_start date, window_end date"
    lo, hi = dt.date(2023, 1, 1), dt.date(2025, 3, 31)

    def row(y, m, d, a=lo, b=hi):
        return (dt.datetime(y, m, d), dt.date(y, m, d), a, b)

    rows = [row(2023, 1, 1), row(2025, 3, 31), row(2022, 12, 31), row(2025, 4, 1), row(2026, 1, 1), row(2000, 1, 1, None), (None, None, lo, hi)]
    now = F.lit("2025-06-15 00:00:00").cast("timestamp_ntz")
    flags = column_of(spark, integrity.timestamp_sane_flag(now), schema, rows)
    assert [f["points"] for f in flags] == [3, 3, 0, 0, 0, 3, 0]
    assert flags[2]["detail"] == "captured_at 2022-12-31 is before project window start 2023-01-01"
    assert flags[4]["detail"] == "captured_at is in the future"


def test_duplicate_flag_texts(spark):
    flag = integrity.duplicate_photo_flag(has_photo="p")
    out = column_of(spark, flag, "min_distance int, p boolean", [(6, True), (None, True), (None, False)])
    assert [f["points"] for f in out] == [0, 5, 5]
    assert out[0]["detail"] == "near-duplicate photo found (hamming distance 6 <= 6)"
    assert out[2]["detail"] == "no photo hash available to compare"


@pytest.mark.parametrize(
    "match,confidence,score,gated,flags",
    [
        ("yes", 0.75, 30, False, []),
        ("yes", 0.7499, 20, False, []),
        ("yes", 0.5, 20, True, ["low_confidence_review"]),
        ("yes", 0.4999, 10, True, ["low_confidence_review"]),
        ("uncertain", 0.95, 10, True, ["uncertain_match_review"]),
        ("no", 0.99, 0, False, ["activity_mismatch"]),
        ("no", 0.59, 0, True, ["activity_mismatch", "low_confidence_review"]),
    ],
)
def test_visual_rules(spark, match, confidence, score, gated, flags):
    row = (
        spark.createDataFrame([(match, confidence)], "matches_declared string, confidence double")
        .select(visual.visual_score().alias("s"), visual.needs_review().alias("g"), visual.review_flags().alias("f"))
        .first()
    )
    assert (row["s"], row["g"], row["f"]) == (score, gated, flags)


OBJECT = '{"a": {"b": 1}, "evidence": "x"}'


@pytest.mark.parametrize(
    "answer,found",
    [
        (OBJECT, OBJECT),
        (f"  {OBJECT}\n", OBJECT),
        (f"```json\n{OBJECT}\n```", OBJECT),
        (f"```\n{OBJECT}\n``` and more", OBJECT),
        (f"Sure: {OBJECT} hope {{that}} helps", OBJECT),
        ('{"a":1} {"b":2}', '{"a":1}'),
        ('{"a":1}, {"b":2}', '{"a":1}'),
        ('{"a":1}] x', '{"a":1}'),
        ("[1, 2, 3]", None),
        ("not json at all", None),
        ('{"a": 1', None),
        ("", None),
    ],
)
def test_json_recovery(spark, answer, found):
    assert one(spark, visual.extract_json_object("t"), t=("string", answer)) == found


def response(**change):
    import json

    base = {
        "predicted_category": "PT",
        "predicted_activity": "Farm Pond",
        "construction_stage": "completed",
        "water_visible": "yes",
        "vegetation_cover": "low",
        "matches_declared": "yes",
        "confidence": 0.9,
        "evidence": "pond",
    }
    base.update(change)
    return json.dumps({k: v for k, v in base.items() if v is not ...})


@pytest.mark.parametrize(
    "change,valid",
    [
        ({}, True),
        ({"confidence": 1}, True),
        ({"confidence": 1.01}, False),
        ({"confidence": -0.01}, False),
        ({"confidence": "high"}, False),
        ({"predicted_category": "ZZ"}, False),
        ({"predicted_category": "UNKNOWN"}, True),
        ({"extra": 1}, False),
        ({"evidence": ...}, False),
        ({"evidence": ""}, False),
        ({"evidence": "e" * 500}, True),
        ({"evidence": "e" * 501}, False),
        ({"predicted_activity": "a" * 201}, False),
        ({"water_visible": "maybe"}, False),
        ({"matches_declared": None}, False),
        ({"predicted_activity": 123}, False),
        ({"evidence": {"a": 1}}, False),
        ({"evidence": None}, False),
        ({"evidence": ["x"]}, False),
        ({"confidence": None}, False),
    ],
)
def test_response_schema(spark, change, valid):
    df = spark.createDataFrame([(response(**change),)], "raw_json string")
    row = visual.validate_or_degrade(df).first()
    assert (len(row["response_errors"]) == 0) == valid
    if not valid:
        assert row["result"]["matches_declared"] == "uncertain" and row["visual_score"] == 10 and row["needs_review"]
        assert row["result"]["evidence"].startswith("Classifier response invalid after 2 attempt(s): ")
        assert len(row["result"]["evidence"]) <= 500


def test_blank_evidence_is_filled_on_request(spark):
    df = spark.createDataFrame([(response(evidence="  "),)], "raw_json string")
    row = visual.validate_or_degrade(df, fill_evidence=True).first()
    assert row["response_errors"] == [] and row["result"]["evidence"] == C.EMPTY_EVIDENCE_TEXT


def test_provider_errors_are_rows(spark):
    good = response()

    def failing_provider():
        def answer(row):
            if row["record_id"] == 2:
                raise RuntimeError("model is down")
            return good

        return answer

    df = spark.createDataFrame([(1,), (2,), (3,)], "record_id long")
    rows = {r["record_id"]: r for r in visual.validate_or_degrade(visual.classify(df, failing_provider)).collect()}
    assert rows[2]["error"] == "model is down" and rows[2]["result"]["matches_declared"] == "uncertain"
    assert rows[1]["error"] is None and rows[3]["visual_score"] == 30
    assert "after 2 attempt(s)" in rows[2]["result"]["evidence"] and (rows[1]["attempts"], rows[2]["attempts"]) == (1, 2)


def test_invalid_answers_are_asked_again(spark):
    good = response()

    def hesitant_provider():
        return lambda row: good if row["attempt"] > row["record_id"] else '{"confidence": 2}'

    df = spark.createDataFrame([(0,), (1,), (2,), (3,)], "record_id long")
    out = visual.validate_or_degrade(visual.classify(df, hesitant_provider, attempts=3)).collect()
    assert {r["record_id"]: (r["attempts"], len(r["response_errors"]) == 0) for r in out} == {0: (1, True), 1: (2, True), 2: (3, True), 3: (3, False)}
    assert [r for r in out if r["record_id"] == 3][0]["result"]["evidence"].startswith("Classifier response invalid after 3 attempt(s): ")


def test_stored_hashes_count_whatever_their_ids(spark):
    stored = photos.stored_hashes(spark.createDataFrame([(100, 7), (60, 1 << 40)], "record_id long, phash long"))
    new = spark.createDataFrame([(50, 7), (60, 1 << 40), (70, 15), (80, 1 << 20)], "record_id long, phash long")
    got = {r["record_id"]: r["min_distance"] for r in photos.duplicate_distance(new, stored=stored).collect()}
    assert got == {50: 0, 60: 4, 70: 1, 80: 2}


@pytest.mark.parametrize("index", sorted(C.DID_THRESHOLDS))
def test_did_thresholds(spark, index):
    strong, weak = C.DID_THRESHOLDS[index]
    e = 1e-6
    values = [strong, strong - e, weak, weak - e, 0.0, -weak + e, -weak]
    got = column_of(spark, scoring.classify_did("i", "v"), "i string, v double", [(index, v) for v in values])
    w = "weakly_positive"
    assert got == ["strongly_positive", w, w, "inconclusive", "inconclusive", "inconclusive", "negative"]


def satellite(spark, category, ndvi=None, mndwi=None, ndmi=None, water=None):
    schema = "category string, did_ndvi double, did_mndwi double, did_ndmi double, did_water_fraction double"
    return scoring.satellite_score(spark.createDataFrame([(category, ndvi, mndwi, ndmi, water)], schema)).first()


def test_satellite_routing(spark):
    assert satellite(spark, "PT", water=0.2)["satellite_score"] == 30
    fallback = satellite(spark, "pt", mndwi=0.05)
    assert (fallback["primary_index"], fallback["satellite_score"]) == ("MNDWI", 30)
    mean = satellite(spark, "BN", ndvi=0.1, ndmi=0.06)
    assert (mean["primary_index"], mean["satellite_score"]) == ("NDVI_NDMI_MEAN", 30)
    quiet = satellite(spark, "LS", ndvi=0.9)
    assert (quiet["did_class"], quiet["satellite_score"], quiet["primary_index"]) == ("not_applicable", 15, None)
    down = satellite(spark, "VM", ndvi=-0.5)
    assert down["satellite_score"] == 0 and "too early post-work" in down["satellite_note"]
    unknown = satellite(spark, "ZZ", ndvi=0.5)
    assert unknown["satellite_score"] is None and unknown["error"] == "unknown category ZZ"
    assert satellite(spark, "AM")["did_class"] == "inconclusive"


def test_bands(spark):
    rows = [(70, False), (69, False), (40, False), (39, False), (90, True), (20, True), (None, False)]
    got = column_of(spark, scoring.evidence_band(), "evidence_score int, needs_review boolean", rows)
    assert got == ["verified", "review", "review", "flag", "review", "flag", None]


def test_status_and_category(spark):
    statuses = ["", "  ", None, "Accepted", " yet to moderate ", "Accepted Rejected", "Rejected (late)", "On hold"]
    got = column_of(spark, registry.status_slug("s"), "s string", [(s,) for s in statuses])
    assert got == ["not_submitted"] * 3 + ["accepted", "yet_to_moderate", "mixed", "rejected", "other"]
    names = ["Farm Ponds", "CONTOUR BUNDING", "Irrigation/Drainage Channel", "Bee Keeping & Dairy", "Borewell", "Amrit Sarovar"]
    got = column_of(spark, registry.activity_category("a"), "a string", [(n,) for n in names])
    assert got == ["PT", "BN", "NC", "LS", "OM", "PT"]


def test_percentages_round_half_even(spark):
    share = registry.share_pct(F.col("a"), F.col("b"))
    assert column_of(spark, share, "a long, b long", [(123, 240), (0, 0), (109, 240)]) == [51.2, 0.0, 45.4]
    pct = coverage.coverage_pct("g", "t")
    assert column_of(spark, pct, "g long, t long", [(5, 4), (0, 0), (81, 1053)]) == [100.0, 0.0, 7.7]


def test_name_key_and_slug(spark):
    names = ["  Ri-Bhoi ", "West  Garo Hills District", "St. John's", "KAMRUP"]
    assert column_of(spark, text.name_key("n"), "n string", [(n,) for n in names]) == ["ribhoi", "west garo hills", "st johns", "kamrup"]
    titles = ["File:Étang près d'Arles (1).JPG", "File:কৃষি.jpg", "File:" + "a b" * 40 + ".png"]
    slugs = column_of(spark, text.ascii_slug("t"), "t string", [(x,) for x in titles])
    assert slugs[:2] == ["etang-pres-d-arles-1", "photo"] and len(slugs[2]) == 60


def test_query_params(spark):
    url = "get?dcode=296&name=A+B%20C&x&empty=&dcode=297"
    assert one(spark, text.query_params("u"), u=("string", url)) == {"dcode": "297", "name": "A B C", "empty": ""}
    assert one(spark, text.query_params("u"), u=("string", "no-query")) == {}
    assert one(spark, text.query_param("u", "dcode"), u=("string", url)) == "297"


def test_unescape(spark):
    cases = {"a &amp;lt; b": "a &lt; b", "&lt;&#65;&#x42;&gt; &copy;": "<AB> ©", "&nosuch; &": "&nosuch; &", "plain": "plain"}
    got = column_of(spark, text.unescape("t"), "t string", [(k,) for k in cases])
    assert got == list(cases.values())


def test_exclusion_order_and_ties(spark):
    schema = "polygon_id string, pos long, area_ha double, crop_share double, built_up_share double, water_share double, mean_slope_deg double, pixel_count long"
    rows = [
        ("a", 0, 1000.0, 0.5, 0.05, 0.05, 4.0, 10),
        ("b", 1, 1000.0, 0.5, 0.05, 0.05, None, 10),  # same score as a: input order decides
        ("c", 2, 1000.0, 0.9, 0.15, 0.30, 1.0, 10),  # on both limits: eligible
        ("d", 3, 49.9, 0.5, 0.9, 0.05, 8.0, 0),
        ("e", 4, 49.9, 0.5, 0.9, 0.05, 8.01, 5),
        ("f", 5, 8000.1, 0.5, 0.05, 0.05, 4.0, 5),
        ("g", 6, 1000.0, 0.5, 0.151, 0.05, 4.0, 5),
        ("h", 7, 1000.0, 0.5, 0.05, 0.301, 4.0, 5),
    ]
    out = {r["polygon_id"]: r for r in ranking.rank_candidates(spark.createDataFrame(rows, schema)).collect()}
    assert [out[k]["rank"] for k in "abcdefgh"] == [2, 3, 1, None, None, None, None, None]
    assert out["d"]["exclusion_reason"] == C.NO_PIXELS_REASON
    assert out["e"]["exclusion_reason"] == "area_ha 49.9 < MIN_AREA_HA 50.0"
    assert out["g"]["exclusion_reason"] == "built_up_share 0.151 > MAX_BUILT_UP_SHARE 0.15"
    assert [out[k]["in_slope_band"] for k in "abcde"] == [True, None, True, True, False]


def test_control_tolerances(spark):
    schema = "polygon_id string, pos long, crop_share double, mean_slope_deg double, excluded boolean"
    treated = spark.createDataFrame([("t", 0, 0.5, 4.0, False)], schema)
    rows = [("t", 0, 0.5, 4.0, False), ("a", 1, 0.574, 7.0, False), ("b", 2, 0.58, 4.0, False), ("c", 3, 0.5, 7.01, False), ("d", 4, 0.5, None, False), ("e", 5, 0.5, 4.0, True)]
    pool = spark.createDataFrame(rows, schema)
    out = {r["polygon_id"]: r["slope_match"] for r in ranking.match_controls(treated, pool).collect()}
    assert out == {"a": "true", "d": "not_evaluated_missing_slope"}
    assert ranking.match_controls(treated.where("false"), pool).count() == 0


def test_accuracy_status(spark):
    rows = [(0, None, None), (10, None, None), (10, False, 0), (10, True, 5), (10, True, 4)]
    got = column_of(spark, evaluation.accuracy_status("n", "f", "b"), "n int, f boolean, b int", rows)
    assert got == ["not_established", "measured", "not_established", "not_established", "measured"]


def test_validation(spark):
    schema = "mws_id string, category string, lat double, lon double, is_synthetic boolean, photo_source string"
    rows = [
        ("W", "PT", 1.0, 1.0, False, None),
        ("W", "PT", 1.0, 1.0, True, None),
        ("W", "PT", 1.0, 1.0, True, "field"),
        ("W", "PT", 1.0, 1.0, True, "stock_cc"),
        ("W", "ZZ", 1.0, 1.0, False, "field"),
        ("W", "PT", None, 1.0, None, None),
    ]
    out = validate.validate_records(spark.createDataFrame(rows, schema)).collect()
    assert [len(r["errors"]) for r in out] == [0, 1, 1, 0, 1, 1]
    assert out[0]["photo_source"] == "field" and out[5]["is_synthetic"] is False


def test_temporal_rule(spark):
    def p(asset, *points):
        return [(asset, dt.datetime(2024, 1, d), s) for d, s in points]

    ns, uc, co = C.ORDERED_STAGES
    rows = p("up", (1, ns), (2, uc), (3, co)) + p("one", (1, uc)) + p("back", (1, co), (2, ns)) + p("flat", (1, uc), (2, uc)) + p("skip", (1, ns), (5, co), (6, "unclear"))
    df = spark.createDataFrame(rows, "asset_id string, ts timestamp_ntz, stage string")
    got = {r["asset_id"]: r["temporal_score"] for r in scoring.temporal_score(df).collect()}
    assert got == {"up": 10, "one": 5, "back": 0, "flat": 0, "skip": 10}


def test_slugs_fold_like_unicode(spark):
    titles = ["File:Rājā ő ﬁne ² Šipka.jpg", "½ ㎏ Ⅷ Å ø.png", "കേരളം.jpg", "𝐁old ｆull.x", "àÿ Ñ.jpeg", "a" * 80, "", "…dots.", "ＦＩＬＥ"]
    df = spark.createDataFrame(list(enumerate(titles)), "i int, t string")
    for row in df.select("i", text.ascii_slug("t").alias("s")).collect():
        name = titles[row["i"]].removeprefix("File:")
        stem = re.sub(r"(?<=.)\.[^.]+$", "", name.split("/")[-1])
        plain = unicodedata.normalize("NFKD", stem).encode("ascii", "ignore").decode()
        assert row["s"] == (re.sub(r"[^a-zA-Z0-9]+", "-", plain).strip("-").lower() or "photo")[:60], titles[row["i"]]
