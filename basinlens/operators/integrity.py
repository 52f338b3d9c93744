"""Geo-integrity rules: five flags per record and their sum (0-30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinlens import constants as C
from basinlens.functions.geo import haversine_m
from basinlens.operators.photos import duplicate_distance
from basinlens.operators.spatial import flag_inside_own_polygon
from basinlens.operators.validate import check_reference, split_valid, validate_records

_PTS = C.RULE_POINTS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _flag(rule: str, passed: Column, points: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        passed.alias("passed"),
        points.cast("int").alias("points"),
        F.lit(_PTS[rule]).alias("max"),
        detail.alias("detail"),
    )


# Each rule has a case (a short code, the costly part) and a flag made from the case.  A plan
# that needs points, pass mark and text evaluates the case once, as a column of its own.


def gps_case(accuracy="gps_accuracy_m") -> Column:
    a = _col(accuracy)
    return F.when(a.isNull(), "missing").when(a <= C.GPS_GOOD_M, "good").when(a <= C.GPS_OK_M, "fair").otherwise("poor")


def gps_accuracy_flag(accuracy="gps_accuracy_m", case=None) -> Column:
    case = gps_case(accuracy) if case is None else _col(case)
    text = _col(accuracy).cast("string")
    points = F.when(case == "good", _PTS["gps_accuracy"]).when(case == "fair", C.GPS_PARTIAL_POINTS).otherwise(0)
    detail = (
        F.when(case == "missing", F.lit(C.DETAIL["gps_missing"]))
        .when(case == "good", F.concat(text, F.lit(f"m <= {C.GPS_GOOD_M}m")))
        .when(case == "fair", F.concat(text, F.lit(f"m within {C.GPS_GOOD_M}-{C.GPS_OK_M}m band (partial credit)")))
        .otherwise(F.concat(text, F.lit(f"m exceeds {C.GPS_OK_M}m threshold")))
    )
    return _flag("gps_accuracy", case == "good", points, detail)


def inside_boundary_flag(inside="inside") -> Column:
    i = F.coalesce(_col(inside), F.lit(False))
    detail = F.when(i, F.lit(C.DETAIL["inside"])).otherwise(F.lit(C.DETAIL["outside"]))
    return _flag("inside_boundary", i, F.when(i, _PTS["inside_boundary"]).otherwise(0), detail)


def exif_case(
    lat="lat", lon="lon", captured_date="captured_date", exif_lat="exif_lat", exif_lon="exif_lon", exif_ts="exif_ts"
) -> Column:
    """``captured_date`` is the date as written in the record's own offset."""
    elat, elon, ets = _col(exif_lat), _col(exif_lon), _col(exif_ts)
    has_gps, has_time = elat.isNotNull() & elon.isNotNull(), ets.isNotNull()
    gps_ok = F.coalesce(haversine_m(lat, lon, elat, elon) <= C.EXIF_TOLERANCE_M, F.lit(False)).cast("int")
    time_ok = F.coalesce(F.to_date(ets) == _col(captured_date), F.lit(False)).cast("int")
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("exif_neither", "exif_one_matches", "exif_both")]), gps_ok + time_ok + 1)
    return F.when(has_gps & has_time, outcome).when(has_gps | has_time, "exif_partial").otherwise("exif_none")


def exif_consistency_flag(case=None) -> Column:
    """Both tags: full for two matches, partial for one; one tag alone: partial whatever it says."""
    case = exif_case() if case is None else _col(case)
    points = (
        F.when(case == "exif_both", _PTS["exif_consistency"])
        .when(case.isin("exif_partial", "exif_one_matches"), C.EXIF_PARTIAL_POINTS)
        .otherwise(0)
    )
    texts = F.create_map(*[F.lit(x) for k, v in C.DETAIL.items() if k.startswith("exif_") for x in (k, v)])
    return _flag("exif_consistency", case == "exif_both", points, texts[case])


def duplicate_photo_flag(min_distance="min_distance", has_photo=None) -> Column:
    """``min_distance`` is null when no stored photo is near; ``has_photo`` false when there is no hash text."""
    d = _col(min_distance)
    near = d.isNotNull()
    text = F.concat(
        F.lit("near-duplicate photo found (hamming distance "),
        d.cast("string"),
        F.lit(f" <= {C.DUPLICATE_MAX_HAMMING})"),
    )
    detail = F.when(near, text)
    if has_photo is not None:
        detail = detail.when(~_col(has_photo), F.lit(C.DETAIL["hash_missing"]))
    detail = detail.otherwise(F.lit(C.DETAIL["hash_unique"]))
    return _flag("duplicate_photo", ~near, F.when(near, 0).otherwise(_PTS["duplicate_photo"]), detail)


def time_case(
    now, captured_at="captured_at", captured_date="captured_date", window_start="window_start", window_end="window_end"
) -> Column:
    """``now`` is given by the caller, so a rerun scores the same."""
    ts, day = _col(captured_at), _col(captured_date)
    return (
        F.when(ts.isNull(), "missing")
        .when(ts > now, "future")
        .when(day < _col(window_start), "early")
        .when(day > _col(window_end), "late")
        .otherwise("ok")
    )


def timestamp_sane_flag(
    now=None, captured_date="captured_date", window_start="window_start", window_end="window_end", case=None
) -> Column:
    case = time_case(now) if case is None else _col(case)
    when = F.concat(F.lit("captured_at "), _col(captured_date).cast("string"))
    detail = (
        F.when(case == "ok", F.lit(C.DETAIL["time_ok"]))
        .when(case == "missing", F.lit(C.DETAIL["time_missing"]))
        .when(case == "future", F.lit(C.DETAIL["time_future"]))
        .when(case == "early", F.concat(when, F.lit(" is before project window start "), _col(window_start).cast("string")))
        .otherwise(F.concat(when, F.lit(" is after project window end "), _col(window_end).cast("string")))
    )
    return _flag("timestamp_sane", case == "ok", F.when(case == "ok", _PTS["timestamp_sane"]).otherwise(0), detail)


def geo_score(flags="geo_flags") -> Column:
    return F.aggregate(_col(flags), F.lit(0), lambda acc, f: acc + f["points"])


def score_records(
    records: DataFrame,
    watersheds: DataFrame,
    edges: DataFrame,
    photos: DataFrame,
    now,
    band_size: float = 1 / 16,
    blocks: int | None = None,
    history: str = "before",
    **earlier,
) -> DataFrame:
    """Records with ``geo_flags`` (fixed rule order) and ``geo_score``.

    ``watersheds``: mws_id, window_start, window_end.  ``edges``: mws_id + sides.
    ``photos``: record_id, phash, one row per photo.  Records must have passed the
    reference check; a record is never dropped for a bad score.  ``earlier`` photos count
    too: ``stored``, or ``index`` and ``before`` (see ``photos.duplicate_distance``).
    """
    windows = watersheds.select("mws_id", "window_start", "window_end")
    located = flag_inside_own_polygon(records, edges, "mws_id", band_size)
    near = duplicate_distance(photos, history, blocks, **earlier)
    # a record without a readable hash still "has a photo" when any hash text was given
    joined = located.join(windows, "mws_id", "left").join(near, "record_id", "left")
    has_photo = F.col("has_photo") if "has_photo" in records.columns else F.lit(True)
    cased = joined.withColumns({"_gps": gps_case(), "_exif": exif_case(), "_time": time_case(now)})
    flags = F.array(
        gps_accuracy_flag(case="_gps"),
        inside_boundary_flag(),
        exif_consistency_flag(case="_exif"),
        duplicate_photo_flag(has_photo=has_photo),
        timestamp_sane_flag(case="_time"),
    )
    return cased.select(*records.columns, flags.alias("geo_flags")).withColumn("geo_score", geo_score())


def ingest(records: DataFrame, watersheds: DataFrame, edges: DataFrame, photos: DataFrame, now, **options):
    """(scored, quarantine): schema-invalid rows and unknown watersheds are kept with their reason.

    Photos of refused records are not stored, so they make no accepted one a duplicate.
    """
    valid, invalid = split_valid(validate_records(records))
    known, orphan = check_reference(valid, watersheds, "mws_id")
    accepted = photos.join(known.select("record_id"), "record_id", "left_semi")
    scored = score_records(known, watersheds, edges, accepted, now, **options)
    orphan = orphan.withColumn("errors", F.array(F.lit("mws_id not found")))
    return scored, invalid.unionByName(orphan)
