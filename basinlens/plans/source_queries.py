"""Round trips through the file formats: written from the tables, read back through the typed readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basinlens.operators import evaluation
from basinlens.plans.catalogue import q6, query, r6
from basinlens.plans.registry_queries import CATEGORY, display, work_pages
from basinlens.plans.scoring_queries import _SUMMARY
from basinlens.plans.tables import Tables
from basinlens.operators import registry
from basinlens.session import scratch_path
from basinlens.sources import files, geojson, report_html

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ground_truth_category", T.StringType()),
        T.StructField("is_mismatch_test", T.BooleanType()),
    ]
)


@query(
    "json_array_scan",
    "select doc_id id, gt ground_truth_category, doc_id%17=0 is_mismatch_test from a_eval",
)
def json_array_scan(t: Tables) -> DataFrame:
    """Manifests of at most 100 photos, one JSON array per file."""
    path = scratch_path(t.spark, "manifest")
    item = F.struct(F.col("doc_id").alias("id"), F.col("gt").alias("ground_truth_category"), (F.col("doc_id") % 17 == 0).alias("is_mismatch_test"))
    arrays = t.eval.groupBy(F.floor(F.col("doc_id") / 100).alias("part")).agg(F.to_json(F.collect_list(item)).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_json_array(t.spark, path, MANIFEST_SCHEMA)


@query(
    "summary_files",
    f"select concat('m', model) model, n_photos, n_correct, accuracy, case when n_schema_invalid_responses/n_photos>=0.5 then 'not_established' else 'measured' end accuracy_status from ({_SUMMARY})",
)
def summary_files(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "summaries")
    s = evaluation.accuracy_summary(t.eval, ["model"]).withColumn("model", F.concat(F.lit("m"), "model"))
    s.write.option("maxRecordsPerFile", 1).json(path)
    out = files.read_summaries(t.spark, f"{path}/*.json")
    return out.select("model", "n_photos", "n_correct", "accuracy", "accuracy_status")


@query(
    "json_lines_rewrite",
    """select page_id, case when url like 'http://%' then concat('https://photos.example.org/', substr(url, 8)) else url end url from pages""",
)
def json_lines_rewrite(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "dump")
    t.base("pages").select("page_id", "url").write.json(path)
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType())])
    return files.read_json_lines(t.spark, path, schema, "url", ("http://", "https://photos.example.org/"))


@query(
    "registry_csv",
    f"""select work_code, head, activity, {CATEGORY} category, {display('pre_status')} pre_status, {display('mid_status')} mid_status, {display('post_status')} post_status,
   'https://reports.example.org/a,b' source_url, '2025-01-01' retrieved_at from a_work""",
)
def registry_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "registry")
    rows = registry.workcode_rows(report_html.table_rows(work_pages(t)))
    files.write_registry_csv(rows, path, "https://reports.example.org/a,b", "2025-01-01")
    return files.read_registry_csv(t.spark, path)


def parcel_features(t: Tables) -> DataFrame:
    """GeoJSON texts: mostly Polygon, some MultiPolygon, some of a type that is refused."""
    x, y, w = F.col("x0"), F.col("y0"), F.col("w")
    ring = F.array(*[F.array(x + w * a, y + w * b) for a, b in ((0, 0), (1, 0), (1, 1), (0.5, 0.5), (0, 1), (0, 0))])
    k = F.col("pos")
    polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring)).alias("coordinates")))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), ring.alias("coordinates")))
    geometry = F.when(k % 11 == 5, line).when(k % 7 == 0, multi).otherwise(polygon)
    text = F.concat(
        F.lit('{"type":"Feature","properties":{"id":"'), F.col("polygon_id"), F.lit('","rank":'), k.cast("string"), F.lit('},"geometry":'), geometry, F.lit("}")
    )
    return t.parcels.select("pos", text.alias("value"))


@query(
    "geojson_features",
    """select polygon_id id, pos as rank, case when pos%11=5 then 'refused' else 'feature' end status, case when pos%11<>5 then x0 end xmin, case when pos%11<>5 then y0+w end ymax, case when pos%11<>5 then 5 else 0 end n_edges from a_parcels""",
)
def geojson_features(t: Tables) -> DataFrame:
    """Collections of at most 50 features per file, parsed to features, edges and rejects."""
    path = scratch_path(t.spark, "features")
    page = parcel_features(t).groupBy(F.floor(F.col("pos") / 50).alias("page")).agg(F.array_join(F.collect_list("value"), ",").alias("body"))
    page.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "body", F.lit("]}")).alias("value")).write.option(
        "maxRecordsPerFile", 1
    ).text(path)
    good, refused = geojson.parse_features(geojson.read_collection(t.spark, path), {"id": "string", "rank": "bigint"})
    sides = geojson.parts_to_edges(good, "id").groupBy("id").agg(
        F.min("x1").alias("xmin"), F.max("y1").alias("ymax"), F.count(F.lit(1)).cast("int").alias("n_edges")
    )
    a = good.select("id", "rank").join(sides, "id").select("id", "rank", F.lit("feature").alias("status"), "xmin", "ymax", "n_edges")
    none = F.lit(None).cast("double")
    b = refused.select(
        F.get_json_object("text", "$.properties.id").alias("id"),
        F.get_json_object("text", "$.properties.rank").cast("bigint").alias("rank"),
        F.lit("refused").alias("status"),
        none.alias("xmin"),
        none.alias("ymax"),
        F.lit(0).alias("n_edges"),
    )
    return a.unionByName(b)


@query(
    "geojson_export",
    "select record_id, category, 'Point' kind, lon, lat, gps_accuracy_m from a_records",
)
def geojson_export(t: Tables) -> DataFrame:
    """One feature per line out, and the fields read back."""
    path = scratch_path(t.spark, "export")
    geojson.write_features(t.records, path, ["record_id", "category", "gps_accuracy_m"])
    lines = t.spark.read.text(path)

    def at(p: str, kind: str):
        return F.get_json_object("value", p).cast(kind)

    return lines.select(
        at("$.properties.record_id", "bigint").alias("record_id"),
        at("$.properties.category", "string").alias("category"),
        at("$.geometry.type", "string").alias("kind"),
        at("$.geometry.coordinates[0]", "double").alias("lon"),
        at("$.geometry.coordinates[1]", "double").alias("lat"),
        at("$.properties.gps_accuracy_m", "double").alias("gps_accuracy_m"),
    )


@query(
    "geojson_pages",
    "select mws_id, cast(floor(record_id/1000e0) as bigint) page, count(*) n_features, count(*) parsed from a_records group by 1,2",
)
def geojson_pages(t: Tables) -> DataFrame:
    pages = geojson.feature_collections(t.records, "mws_id", ["record_id", "category"], "record_id", 1000)
    parsed = F.size(F.from_json(F.get_json_object("collection", "$.features"), "array<string>")).cast("bigint")
    return pages.select("mws_id", "page", "n_features", parsed.alias("parsed"))


@query(
    "series_documents",
    f"select unit_id, idx, y as year, {q6('v')} value, 'season means' method from a_series",
)
def series_documents(t: Tables) -> DataFrame:
    """Nested index -> year -> value documents out, and the numbers read back."""
    path = scratch_path(t.spark, "series")
    series = t.series.select(F.col("unit_id").alias("polygon_id"), F.col("idx").alias("index"), F.col("y").alias("year"), F.col("v").alias("value"))
    files.write_series(series, path, {"method": "season means"})
    schema = "polygon_id bigint, series map<string,map<string,double>>, method string"
    back = t.spark.read.schema(schema).json(path)
    by_index = back.select(F.col("polygon_id").alias("unit_id"), "method", F.explode("series").alias("idx", "m"))
    return by_index.select("unit_id", "idx", "method", F.explode("m").alias("year", "value")).select(
        "unit_id", "idx", F.col("year").cast("int").alias("year"), r6("value").alias("value"), "method"
    )
