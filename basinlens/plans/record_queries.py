"""Validation, joins, updates, integrity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinlens import constants as C
from basinlens.functions import geo, text
from basinlens.operators import integrity, photos, ranking, records, validate
from basinlens.plans.catalogue import q6, query, r6
from basinlens.plans.tables import Tables

NOW = "2001-01-01 00:00:00"


def incoming(t: Tables) -> DataFrame:
    """Records as they arrive: some with a bad code, a bad photo source, or an unknown watershed."""
    k = F.col("record_id")
    source = F.when(k % 3 == 0, F.lit("ai_generated")).when(k % 3 == 1, F.lit("field"))
    return (
        t.records.withColumn("category", F.when(k % 41 == 0, F.lit("XX")).otherwise(F.col("category")))
        .withColumn("mws_id", F.when(k % 23 == 0, F.lit("W99")).otherwise(F.col("mws_id")))
        .withColumn("is_synthetic", k % 5 == 0)
        .withColumn("photo_source", source)
    )


INCOMING = """(select record_id, case when record_id%23=0 then 'W99' else mws_id end mws_id,
  case when record_id%41=0 then 'XX' else category end category, record_id%5=0 is_synthetic,
  case when record_id%3=0 then 'ai_generated' when record_id%3=1 then 'field' end photo_source from a_records)"""


@query(
    "record_validation",
    f"""select record_id, is_synthetic,
  case when not is_synthetic then coalesce(photo_source, 'field') else photo_source end photo_source,
  concat(case when category='XX' then 'category is not one of the fixed codes' else '' end,
    case when category='XX' and is_synthetic and coalesce(photo_source,'') <> 'ai_generated' then '; ' else '' end,
    case when is_synthetic and coalesce(photo_source,'') <> 'ai_generated' then 'photo_source is required for synthetic records' else '' end) errors
  from {INCOMING}""",
)
def record_validation(t: Tables) -> DataFrame:
    out = validate.validate_records(incoming(t))
    return out.select("record_id", "is_synthetic", "photo_source", F.array_join("errors", "; ").alias("errors"))


@query(
    "reference_check",
    f"""select i.record_id, i.mws_id, case when w.mws_id is null then 'unknown' else 'known' end status
  from {INCOMING} i left join a_mws w on i.mws_id=w.mws_id""",
)
def reference_check(t: Tables) -> DataFrame:
    known, unknown = validate.check_reference(incoming(t), t.mws, "mws_id")
    both = known.withColumn("status", F.lit("known")).unionByName(unknown.withColumn("status", F.lit("unknown")))
    return both.select("record_id", "mws_id", "status")


@query("watershed_list", "select mws_id, name, state, window_start, window_end from a_mws")
def watershed_list(t: Tables) -> DataFrame:
    mws = t.mws.withColumn("created_at", F.col("pos")).withColumn("geom", F.lit("{}"))
    return records.watershed_summaries(mws).select("mws_id", "name", "state", "window_start", "window_end")


@query("asset_lookup", "select record_id, mws_id, category, lon, lat from a_records where record_id = 42")
def asset_lookup(t: Tables) -> DataFrame:
    return records.lookup(t.records, "record_id", 42).select("record_id", "mws_id", "category", "lon", "lat")


def some_evidence(t: Tables) -> DataFrame:
    """Evidence of the records that have been classified."""
    return t.ai.where("record_id % 4 <> 0").withColumn("visual_score", scoring_visual())


def scoring_visual():
    from basinlens.operators.visual import visual_score

    return visual_score()


VISUAL = """case matches_declared when 'yes' then case when confidence>=0.75 then 30 when confidence>=0.5 then 20 else 10 end
  when 'uncertain' then 10 else 0 end"""


@query(
    "asset_detail",
    f"""select r.record_id, r.mws_id, r.category, r.activity, r.lat, r.lon, r.gps_accuracy_m, false is_synthetic,
  cast(null as varchar) remarks, a.visual_score, cast(null as varchar) band
  from a_records r left join (select record_id, {VISUAL} visual_score from a_ai where record_id%4<>0) a on r.record_id=a.record_id""",
)
def asset_detail(t: Tables) -> DataFrame:
    full = records.asset_detail(t.records, some_evidence(t))
    return full.select(
        "record_id", "mws_id", "category", "activity", "lat", "lon", "gps_accuracy_m", "is_synthetic",
        F.col("remarks").cast("string").alias("remarks"), "visual_score", F.col("band").cast("string").alias("band"),
    )


@query(
    "asset_evidence_join",
    "select r.record_id, r.mws_id, a.matches_declared, a.confidence from a_records r left join "
    "(select * from a_ai where record_id%4<>0) a on r.record_id=a.record_id",
)
def asset_evidence_join(t: Tables) -> DataFrame:
    base = t.records.select("record_id", "mws_id")
    return records.attach_evidence(base, some_evidence(t), ["matches_declared", "confidence"])


@query(
    "provenance_check",
    """select doc_id, gt photo_source, quality=1 is_synthetic,
  case when quality=1 and gt is not null and gt not in ('field','ai_generated','stock_cc','unknown') then 'photo_source is not an allowed value' else '' end errors
  from (select l.doc_id, l.quality, case when l.doc_id%3=0 then 'ai_generated' when l.doc_id%7=0 then 'scan' else null end gt from labels l)""",
)
def provenance_check(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    entries = t.base("labels").select(
        "doc_id",
        (F.col("quality") == 1).alias("is_synthetic"),
        F.when(k % 3 == 0, "ai_generated").when(k % 7 == 0, "scan").alias("photo_source"),
    )
    out = validate.validate_provenance(entries)
    return out.withColumn("errors", F.array_join("errors", "; "))


@query(
    "provenance_kind",
    """select record_id, case when record_id%4=0 then 'placeholder' when record_id%3=0 then 'synthetic' else 'real' end kind,
  record_id%6=0 unconfirmed from a_records""",
)
def provenance_kind(t: Tables) -> DataFrame:
    k = F.col("record_id")
    source = F.when(k % 6 == 0, "union of polygons (automated_ranking_pending_human_confirmation)").when(k % 6 == 1, "survey")
    return t.records.select(
        "record_id",
        validate.provenance_kind(k % 4 == 0, k % 3 == 0).alias("kind"),
        validate.boundary_unconfirmed(source).alias("unconfirmed"),
    )


@query(
    "thematic_layers",
    """with m as (select mws_id, pos%2=0 whole, x0 xmin, y0 ymin, x0+0.125e0 xmax, y0+0.125e0 ymax from a_mws)
  select mws_id, 'ndvi_before' layer, 'raster' kind, whole placeholder, 91.5e0 xmin, 92.5e0 xmax, '' error from m
  union all select mws_id, 'drainage', 'vector', true, xmin, xmax, '' from m
  union all select mws_id, 'water', null, whole, xmin, xmax, 'unrecognised type tiff' from m""",
)
def thematic_layers(t: Tables) -> DataFrame:
    from basinlens.operators.spatial import polygon_boxes

    layer = "struct<type:string,path:string,bounds:array<double>,placeholder:boolean>"
    texts = {
        "ndvi_before": '{"type":"raster_png","path":"a.png","bounds":[91.5,25.5,92.5,26.5]}',
        "drainage": '{"type":"geojson","path":"d.geojson","placeholder":true}',
        "water": '{"type":"tiff","path":"w.tif"}',
        "mystery": '{"type":"raster_png","path":"x.png"}',
    }
    layers = F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), F.from_json(F.lit(v), layer))])
    manifests = t.mws.select("mws_id", (F.col("pos") % 2 == 0).alias("placeholder"), layers.alias("layers"))
    out = validate.resolve_manifest(manifests, polygon_boxes(t.edges, "mws_id"))
    return out.select(
        "mws_id", "layer", "kind", "placeholder", F.col("bounds")[0].alias("xmin"), F.col("bounds")[2].alias("xmax"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query(
    "first_result_match",
    """with res as (select l_orderkey record_id, l_linenumber*100000000+l_partkey*1000+l_suppkey pos,
    case when l_orderkey%53=0 then 'n/a' else cast(cast(l_quantity as int) as varchar) end score from lineitem),
  f as (select record_id, arg_min(score, pos) score from res group by 1)
  select r.record_id, case when f.score='n/a' then null else cast(nullif(f.score,'n/a') as int) end satellite_score,
    case when f.record_id is null then 'no precomputed result' when f.score='n/a' then 'missing a valid integer satellite_score' else '' end match_error
  from a_records r left join f on r.record_id=f.record_id""",
)
def first_result_match(t: Tables) -> DataFrame:
    results = t.base("lineitem").select(
        F.col("l_orderkey").alias("record_id"),
        (F.col("l_linenumber") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"),
        F.when(F.col("l_orderkey") % 53 == 0, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("satellite_score"),
    )
    out = records.first_match(t.records, results)
    return out.withColumn("match_error", F.coalesce("match_error", F.lit("")))


@query(
    "upsert_evidence",
    """select record_id, coalesce(b.matches_declared, a.matches_declared) matches_declared, coalesce(b.confidence, a.confidence) confidence,
    case when b.record_id is null then 1 else 2 end version
  from (select record_id, matches_declared, confidence from a_ai where record_id%2=0) a
  full join (select record_id, 'yes' matches_declared, confidence/2 confidence from a_ai where record_id%3=0) b using (record_id)""",
)
def upsert_evidence(t: Tables) -> DataFrame:
    existing = t.ai.where("record_id % 2 = 0").withColumn("version", F.lit(1))
    change = t.ai.where("record_id % 3 = 0").select(
        "record_id", F.lit("yes").alias("matches_declared"), (F.col("confidence") / 2).alias("confidence"), F.lit(2).alias("version")
    )
    return records.upsert(existing, change, ["record_id"], ["version"])


@query(
    "insert_conflicts",
    "select record_id, case when record_id%2=0 then 'conflict' else 'insert' end outcome from a_ai where record_id%3=0",
)
def insert_conflicts(t: Tables) -> DataFrame:
    fresh, taken = records.insert_conflicts(t.ai.where("record_id % 2 = 0"), t.ai.where("record_id % 3 = 0"), ["record_id"])
    a = fresh.select("record_id", F.lit("insert").alias("outcome"))
    return a.unionByName(taken.select("record_id", F.lit("conflict").alias("outcome")))


@query(
    "patch_boundary",
    """select polygon_id, mws_code, case when pos%3=0 then w*2 else w end w, case when pos%3=0 then 'surveyed' else 'sketch' end boundary_source from a_parcels""",
)
def patch_boundary(t: Tables) -> DataFrame:
    target = t.parcels.select("polygon_id", "mws_code", "w", F.lit("sketch").alias("boundary_source"))
    patch = t.parcels.where("pos % 3 = 0").select("polygon_id", (F.col("w") * 2).alias("w"), F.lit("surveyed").alias("boundary_source"))
    return records.patch_columns(target, patch, "polygon_id", ["w", "boundary_source"])


@query(
    "resolve_entries",
    """with e as (select polygon_id entry from a_parcels where pos%2=0 union select distinct mws_code from a_parcels),
  s as (select mws_code, arg_max(polygon_id, pos) polygon_id from a_parcels group by 1)
  select e.entry, coalesce(p.polygon_id, s.polygon_id) polygon_id, case when p.polygon_id is not null then 'primary' else 'secondary' end resolved_by
  from e left join a_parcels p on p.polygon_id=e.entry left join s on s.mws_code=e.entry""",
)
def resolve_entries(t: Tables) -> DataFrame:
    ids = t.parcels.where("pos % 2 = 0").select(F.col("polygon_id").alias("entry"))
    entries = ids.unionByName(t.parcels.select(F.col("mws_code").alias("entry")).distinct())
    return records.resolve_entries(entries, t.parcels, "polygon_id", "mws_code").select("entry", "polygon_id", "resolved_by")


@query(
    "control_geometry_join",
    """select m.polygon_id, case when g.polygon_id is null then 'missing' else 'found' end status, g.w
  from (select concat('P', pos*2) polygon_id from a_parcels) m left join a_parcels g on m.polygon_id=g.polygon_id""",
)
def control_geometry_join(t: Tables) -> DataFrame:
    matches = t.parcels.select(F.concat(F.lit("P"), F.col("pos") * 2).alias("polygon_id"))
    found, missing = records.join_back_geometry(matches, t.parcels.select("polygon_id", "w"), "polygon_id")
    a = found.select("polygon_id", F.lit("found").alias("status"), "w")
    return a.unionByName(missing.select("polygon_id", F.lit("missing").alias("status"), F.lit(None).cast("double").alias("w")))


@query(
    "union_registers",
    """select o_orderkey id, 'open' register, o_totalprice amount from orders where o_orderstatus='O'
  union all select o_orderkey, 'closed', o_totalprice from orders where o_orderstatus='F'
  union all select o_orderkey, 'partial', o_totalprice from orders where o_orderstatus not in ('O','F')
  union all select o_orderkey, 'urgent', null from orders where o_orderpriority='1-URGENT'""",
)
def union_registers(t: Tables) -> DataFrame:
    o = t.base("orders")

    def register(name: str, cond: str, *extra) -> DataFrame:
        return o.where(cond).select(F.col("o_orderkey").alias("id"), F.lit(name).alias("register"), *extra)

    amount = F.col("o_totalprice").alias("amount")
    return records.union_registers(
        register("open", "o_orderstatus='O'", amount),
        register("closed", "o_orderstatus='F'", amount),
        register("partial", "o_orderstatus not in ('O', 'F')", amount),
        register("urgent", "o_orderpriority='1-URGENT'"),
    )


@query("missing_ai_result", "select record_id, category from a_records where record_id%4=0 or record_id%3=1")
def missing_ai_result(t: Tables) -> DataFrame:
    done = t.ai.where("record_id % 4 <> 0").select("record_id", F.when(F.col("matches_declared") != "no", "x").alias("ai_result"))
    return records.missing_result(t.records, done).select("record_id", "category")


# --- integrity rules -------------------------------------------------------------------


def flag_columns(col) -> list:
    return [col["passed"].alias("passed"), col["points"].alias("points"), col["detail"].alias("detail")]


@query(
    "gps_accuracy_rule",
    """select record_id, coalesce(gps_accuracy_m<=10, false) passed, case when gps_accuracy_m<=10 then 8 when gps_accuracy_m<=25 then 4 else 0 end points,
  case when gps_accuracy_m is null then 'gps_accuracy_m missing' when gps_accuracy_m<=10 then concat(cast(gps_accuracy_m as varchar), 'm <= 10.0m')
    when gps_accuracy_m<=25 then concat(cast(gps_accuracy_m as varchar), 'm within 10.0-25.0m band (partial credit)')
    else concat(cast(gps_accuracy_m as varchar), 'm exceeds 25.0m threshold') end detail from a_records""",
)
def gps_accuracy_rule(t: Tables) -> DataFrame:
    return t.records.select("record_id", *flag_columns(integrity.gps_accuracy_flag()))


DIST_EXIF = """2*6371000.0e0*asin(sqrt(pow(sin((radians(exif_lat)-radians(lat))/2),2)+cos(radians(lat))*cos(radians(exif_lat))*pow(sin((radians(exif_lon)-radians(lon))/2),2)))"""
EXIF_CASE = f"""case when exif_lat is null and exif_ts is null then 0 when exif_lat is null or exif_ts is null then 3
    when {DIST_EXIF}<=100 and coalesce(cast(exif_ts as date)=captured_date,false) then 6
    when {DIST_EXIF}<=100 or coalesce(cast(exif_ts as date)=captured_date,false) then 3 else 0 end"""


@query(
    "exif_consistency_rule",
    f"""select record_id, points=6 passed, points, case when exif_lat is null and exif_ts is null then 'no EXIF GPS or timestamp found on photo'
   when exif_lat is null or exif_ts is null then 'only one of EXIF GPS/timestamp present on photo (partial credit)'
   when points=6 then 'EXIF GPS and timestamp both present and consistent with submitted metadata'
   when points=3 then 'EXIF GPS and timestamp both present but only one matches submitted metadata'
   else 'EXIF GPS and timestamp both present but neither matches submitted metadata' end detail
  from (select *, {EXIF_CASE} points from a_records)""",
)
def exif_consistency_rule(t: Tables) -> DataFrame:
    return t.records.select("record_id", *flag_columns(integrity.exif_consistency_flag()))


TIME_POINTS = f"""case when captured_at is null or captured_at > timestamp '{NOW}' or coalesce(captured_date<window_start,false)
   or coalesce(captured_date>window_end,false) then 0 else 3 end"""


@query(
    "timestamp_rule",
    f"""select record_id, {TIME_POINTS}=3 passed, {TIME_POINTS} points, case when captured_at is null then 'captured_at missing'
   when captured_at > timestamp '{NOW}' then 'captured_at is in the future'
   when captured_date<window_start then concat('captured_at ', cast(captured_date as varchar), ' is before project window start ', cast(window_start as varchar))
   when captured_date>window_end then concat('captured_at ', cast(captured_date as varchar), ' is after project window end ', cast(window_end as varchar))
   else 'captured_at within project window and not future-dated' end detail
  from a_records r join a_mws w on r.mws_id=w.mws_id""",
)
def timestamp_rule(t: Tables) -> DataFrame:
    joined = t.records.join(t.mws.select("mws_id", "window_start", "window_end"), "mws_id", "left")
    now = F.lit(NOW).cast("timestamp_ntz")
    return joined.select("record_id", *flag_columns(integrity.timestamp_sane_flag(now)))


INSIDE = """select r.record_id, r.mws_id, (sum(case when (y1>lat)<>(y2>lat) and case when y2>y1 then (x2-x1)*(lat-y1)-(lon-x1)*(y2-y1)>0 else (x2-x1)*(lat-y1)-(lon-x1)*(y2-y1)<0 end then 1 else 0 end)%2=1)
   and max(case when (x2-x1)*(lat-y1)-(lon-x1)*(y2-y1)=0 and lon between least(x1,x2) and greatest(x1,x2) and lat between least(y1,y2) and greatest(y1,y2) then 1 else 0 end)=0 inside
  from a_records r join a_edges e on r.mws_id=e.mws_id group by 1,2"""


@query("inside_boundary_rule", f"select record_id, mws_id, inside, case when inside then 8 else 0 end points from ({INSIDE})")
def inside_boundary_rule(t: Tables) -> DataFrame:
    from basinlens.operators.spatial import flag_inside_own_polygon

    located = flag_inside_own_polygon(t.records.select("record_id", "mws_id", "lon", "lat"), t.edges, "mws_id", 1 / 16)
    return located.select("record_id", "mws_id", "inside", integrity.inside_boundary_flag()["points"].alias("points"))


HASHES = """h as (select record_id, xor(('0x'||substr(base,1,8))::BIGINT, flip::BIGINT) hi, ('0x'||substr(base,9,8))::BIGINT lo from a_photo_hex where base is not null),
 s as (select hi, lo, min(record_id) first_id from h group by 1,2),
 dup as (select h.record_id, min(bit_count(xor(h.hi,s.hi))+bit_count(xor(h.lo,s.lo))) min_distance from h join s
   on s.first_id<h.record_id and bit_count(xor(h.hi,s.hi))+bit_count(xor(h.lo,s.lo))<=6 group by 1)"""


@query(
    "duplicate_photos",
    f"with {HASHES} select record_id, cast(min_distance as int) min_distance from dup",
)
def duplicate_photos(t: Tables) -> DataFrame:
    return photos.duplicate_distance(t.photos())


def scored_records(t: Tables) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    return integrity.score_records(t.records, t.mws, t.edges, t.photos(), now)


SCORED = f"""{HASHES}, ins as ({INSIDE}),
 sc as (select r.record_id, r.mws_id, r.category, case when gps_accuracy_m<=10 then 8 when gps_accuracy_m<=25 then 4 else 0 end p_gps,
   case when inside then 8 else 0 end p_inside, {EXIF_CASE} p_exif, case when dup.record_id is null then 5 else 0 end p_dup, {TIME_POINTS} p_time
   from a_records r join a_mws w on r.mws_id=w.mws_id join ins on ins.record_id=r.record_id left join dup on dup.record_id=r.record_id)"""


@query(
    "geo_integrity_scores",
    f"with {SCORED} select record_id, mws_id, p_gps, p_inside, p_exif, p_dup, p_time, p_gps+p_inside+p_exif+p_dup+p_time geo_score from sc",
)
def geo_integrity_scores(t: Tables) -> DataFrame:
    names = ["p_gps", "p_inside", "p_exif", "p_dup", "p_time"]
    points = [F.col("geo_flags")[i]["points"].alias(n) for i, n in enumerate(names)]
    return scored_records(t).select("record_id", "mws_id", *points, "geo_score")


@query(
    "watershed_integrity",
    f"""with {SCORED} select mws_id, count(*) records, cast(sum(case when p_inside=8 then 1 else 0 end) as bigint) inside,
  cast(sum(case when p_gps=8 then 1 else 0 end) as bigint) well_located, cast(sum(case when p_time=3 then 1 else 0 end) as bigint) in_window,
  cast(sum(case when p_dup=5 then 1 else 0 end) as bigint) unique_photo, {q6("avg(p_gps+p_inside+p_exif+p_dup+p_time)")} mean_geo_score from sc group by 1""",
)
def watershed_integrity(t: Tables) -> DataFrame:
    """Per watershed: records inside, well located, in window, not duplicated, and the mean score."""

    def passed(i: int, name: str):
        return F.count_if(F.col("geo_flags")[i]["passed"]).alias(name)

    return scored_records(t).groupBy("mws_id").agg(
        F.count(F.lit(1)).alias("records"),
        passed(1, "inside"),
        passed(0, "well_located"),
        passed(4, "in_window"),
        passed(3, "unique_photo"),
        r6(F.avg("geo_score")).alias("mean_geo_score"),
    )


REFUSED = "(i.category='XX' or (i.is_synthetic and coalesce(i.photo_source,'') <> 'ai_generated') or w.mws_id is null)"


@query(
    "ingest_outcome",
    f"""with acc as (select i.record_id, i.mws_id, i.category from {INCOMING} i left join a_mws w on i.mws_id=w.mws_id where not {REFUSED}),
  {HASHES.replace("from a_photo_hex where", "from a_photo_hex join acc using (record_id) where")}, ins as ({INSIDE}),
  pts as (select r.record_id, case when gps_accuracy_m<=10 then 8 when gps_accuracy_m<=25 then 4 else 0 end + case when inside then 8 else 0 end
    + {EXIF_CASE} + case when dup.record_id is null then 5 else 0 end + {TIME_POINTS} geo_score
    from a_records r join acc using (record_id) join a_mws w on r.mws_id=w.mws_id join ins on ins.record_id=r.record_id left join dup on dup.record_id=r.record_id)
  select i.record_id, case when {REFUSED} then 'quarantined' else 'scored' end outcome,
   concat(case when i.category='XX' then 'category is not one of the fixed codes' else '' end,
    case when i.category='XX' and is_synthetic and coalesce(photo_source,'') <> 'ai_generated' then '; ' else '' end,
    case when is_synthetic and coalesce(photo_source,'') <> 'ai_generated' then 'photo_source is required for synthetic records' else '' end,
    case when i.category<>'XX' and not (is_synthetic and coalesce(photo_source,'') <> 'ai_generated') and w.mws_id is null then 'mws_id not found' else '' end) errors,
   geo_score
  from {INCOMING} i left join a_mws w on i.mws_id=w.mws_id left join pts on pts.record_id=i.record_id""",
)
def ingest_outcome(t: Tables) -> DataFrame:
    """Every arriving record ends up scored or quarantined; a low score is no reason to refuse."""
    now = F.lit(NOW).cast("timestamp_ntz")
    scored, refused = integrity.ingest(incoming(t), t.mws, t.edges, t.photos(), now)
    a = scored.select("record_id", F.lit("scored").alias("outcome"), F.lit("").alias("errors"), "geo_score")
    b = refused.select("record_id", F.lit("quarantined").alias("outcome"), F.array_join("errors", "; ").alias("errors"))
    return a.unionByName(b, allowMissingColumns=True)


# --- scalar functions --------------------------------------------------------------------


@query("haversine", f"select record_id, round({DIST_EXIF}, 4)+0.0 dist_m from a_records where exif_lat is not null")
def haversine(t: Tables) -> DataFrame:
    dist = geo.haversine_m("lat", "lon", "exif_lat", "exif_lon")
    return t.records.where("exif_lat is not null").select("record_id", (F.round(dist, 4) + F.lit(0.0)).alias("dist_m"))


@query(
    "dms_degrees",
    f"""select o_orderkey record_id, case when o_orderkey%7=0 then null else {q6("(case when o_orderkey%2=0 then -1 else 1 end)*(o_orderkey%90+(o_orderkey%60)/60e0+(o_orderkey%5900)/100e0/3600e0)")} end lat,
   case when o_orderkey%7=0 then null else {q6("(case when o_orderkey%3=0 then -1 else 1 end)*(o_orderkey%180+(o_orderkey%50)/60e0)")} end lon from orders""",
)
def dms_degrees(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")

    def part(num, den: int):
        return F.struct(num.alias("num"), F.lit(den).cast("long").alias("den"))

    lat = F.array(part(k % 90, 1), part(k % 60, 1), part(k % 5900, 100))
    lon = F.when(k % 7 != 0, F.array(part(k % 180, 1), part(k % 50, 1), part(k * 0, 1)))
    gps = geo.exif_gps(lat, F.when(k % 2 == 0, "S").otherwise("N"), lon, F.when(k % 3 == 0, "W"))
    return t.base("orders").select(k.alias("record_id"), r6(gps["lat"]).alias("lat"), r6(gps["lon"]).alias("lon"))


@query(
    "exif_datetime",
    """select o_orderkey record_id, case when o_orderkey%5=0 and o_orderkey%2=0 then null when o_orderkey%5=0 then o_orderdate + interval '1' day else o_orderdate end taken_at from orders""",
)
def exif_datetime(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")

    def tag(when):
        return F.date_format(when, "yyyy:MM:dd HH:mm:ss")

    first = F.when(k % 5 == 0, F.lit("0000:00:00 00:00")).otherwise(tag(d))
    second = F.when(k % 2 == 1, tag(d + F.expr("interval 1 day"))).otherwise(F.lit("not a date"))
    return t.base("orders").select(k.alias("record_id"), geo.exif_timestamp(first, second).alias("taken_at"))


@query(
    "hash_hamming",
    """select o_orderkey record_id, cast(bit_count(xor(('0x'||substr(md5(o_orderkey::varchar),1,8))::BIGINT, ('0x'||substr(md5((o_orderkey+1)::varchar),1,8))::BIGINT))
   + bit_count(xor(('0x'||substr(md5(o_orderkey::varchar),9,8))::BIGINT, ('0x'||substr(md5((o_orderkey+1)::varchar),9,8))::BIGINT)) as int) distance,
   o_orderkey%9<>0 readable from orders""",
)
def hash_hamming(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")

    def text_of(n):
        return F.substring(F.md5(n.cast("string").cast("binary")), 1, 16)

    shown = F.when(k % 9 == 0, F.lit("not-a-hash")).otherwise(text_of(k))
    distance = geo.hamming(geo.hash_from_hex(text_of(k)), geo.hash_from_hex(text_of(k + 1)))
    return t.base("orders").select(k.alias("record_id"), distance.alias("distance"), geo.hash_from_hex(shown).isNotNull().alias("readable"))


_NAME = "concat('  ', replace(c_name, '#', '-'), case when c_custkey%2=0 then '  District' else '' end, case when c_custkey%3=0 then '''s. X' else ' ' end)"


@query(
    "name_key",
    rf"""select c_custkey id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({_NAME}, '^\s+|\s+$', '', 'g')), '\s+district$', ''), '[.\-'']', '', 'g'), '\s+', ' ', 'g') name_key from customer""",
)
def name_key(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(
        F.lit("  "),
        F.replace("c_name", F.lit("#"), F.lit("-")),
        F.when(k % 2 == 0, "  District").otherwise(""),
        F.when(k % 3 == 0, "'s. X").otherwise(" "),
    )
    return t.base("customer").select(k.alias("id"), text.name_key(name).alias("name_key"))


@query("fuzzy_name_filter", "select p_partkey id, p_name from part where p_name ilike '%h%t b%lt%'")
def fuzzy_name_filter(t: Tables) -> DataFrame:
    return t.base("part").where(text.fuzzy_match("p_name", "hat bolt")).select(F.col("p_partkey").alias("id"), "p_name")


@query(
    "url_query_params",
    """select page_id, case when instr(url,'?')>0 and regexp_matches(url,'[?&]page=') then regexp_extract(url,'[?&]page=([^&]*)',1) end page,
   case when instr(url,'?')>0 and regexp_matches(url,'[?&]ref=') then regexp_extract(url,'[?&]ref=([^&]*)',1) end ref from pages""",
)
def url_query_params(t: Tables) -> DataFrame:
    params = text.query_params("url")
    return t.base("pages").select("page_id", params["page"].alias("page"), text.query_param("url", "ref").alias("ref"))


@query(
    "strip_tags_slug",
    r"""select page_id, length(nullif(regexp_replace(regexp_replace(html,'<[^>]+>','','g'),'^\s+|\s+$','','g'),'')) text_chars,
   substr(coalesce(nullif(lower(regexp_replace(regexp_replace(
     regexp_replace(strip_accents(regexp_replace(regexp_replace(regexp_extract(html,'<title>([^<]*)</title>',1),'^.*/',''),'(.)\.[^.]+$','\1')),'[^\x00-\x7f]','','g')
     ,'[^a-zA-Z0-9]+','-','g'),'^-+|-+$','','g')),''),'photo'),1,60) slug from pages""",
)
def strip_tags_slug(t: Tables) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return t.base("pages").select(
        "page_id", F.length(text.strip_tags("html")).alias("text_chars"), text.ascii_slug(title).alias("slug")
    )


@query(
    "review_decisions",
    """with ranked as (select user_id record_id, event_id, ts, case when event_type='purchase' then 'confirmed' else 'rejected' end decision,
    row_number() over (partition by user_id order by ts desc, event_id desc) n from events where event_type in ('purchase','error'))
   select record_id, event_id review_id, decision from ranked where n=1""",
)
def review_decisions(t: Tables) -> DataFrame:
    reviews = t.base("events").select(
        F.col("user_id").alias("record_id"),
        F.col("event_id").alias("review_id"),
        F.col("ts").alias("reviewed_at"),
        F.when(F.col("event_type") == "purchase", "confirmed").when(F.col("event_type") == "error", "rejected").otherwise("open").alias("decision"),
    )
    return ranking.latest_decisions(reviews).select("record_id", "review_id", "decision")


assert C.RULE_POINTS["gps_accuracy"] == 8  # the SQL checks above spell the points out
