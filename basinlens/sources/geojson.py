"""GeoJSON features in and out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POLYGON = "struct<type:string,coordinates:array<array<array<double>>>>"
MULTIPOLYGON = "struct<type:string,coordinates:array<array<array<array<double>>>>>"


def geometry_parts(geometry) -> Column:
    """Coordinates as polygon parts: a Polygon becomes one part; other types give null."""
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    kind = F.get_json_object(g, "$.type")
    one = F.from_json(g, POLYGON)["coordinates"]
    many = F.from_json(g, MULTIPOLYGON)["coordinates"]
    return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)


def parse_features(lines: DataFrame, properties: Mapping[str, str], text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(features: id, properties, parts; rejects: text, reason) from one feature per row.

    ``properties`` maps names to Spark types.  Polygon and MultiPolygon are accepted.
    """
    t = F.col(text)
    geometry = F.get_json_object(t, "$.geometry")
    props = [F.get_json_object(t, f"$.properties.{p}").try_cast(kind).alias(p) for p, kind in properties.items()]
    parsed = lines.select(t.alias("text"), *props, geometry_parts(geometry).alias("parts"), F.get_json_object(geometry, "$.type").alias("_kind"))
    bad = F.col("parts").isNull() | F.exists("parts", lambda p: p.isNull() | (F.size(p) == 0))
    reason = F.concat(F.lit("boundary must be Polygon or MultiPolygon, got "), F.coalesce("_kind", F.lit("none")))
    good = parsed.where(~bad).select(*properties, "parts")
    return good, parsed.where(bad).select("text", reason.alias("reason"))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Features of FeatureCollection files, one JSON text per row (``value``)."""
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    return whole.select(F.explode(items).alias("value"))


def parts_to_edges(features: DataFrame, key: str) -> DataFrame:
    """Edge table (key, part, ring, edge, x1, y1, x2, y2); rings are closed if they are open."""
    rings = features.select(key, F.posexplode("parts").alias("part", "_rings")).select(
        key, "part", F.posexplode("_rings").alias("ring", "_pts")
    )
    closed = F.when(F.col("_pts")[0] == F.element_at("_pts", -1), F.col("_pts")).otherwise(
        F.concat("_pts", F.array(F.col("_pts")[0]))
    )
    sides = F.transform(
        F.slice("_pts", F.lit(1), F.size("_pts") - 1),
        lambda p, i: F.struct(
            p[0].alias("x1"), p[1].alias("y1"), F.get(F.col("_pts"), i + 1)[0].alias("x2"), F.get(F.col("_pts"), i + 1)[1].alias("y2")
        ),
    )
    return (
        rings.withColumn("_pts", closed)
        .select(key, "part", "ring", F.posexplode(sides).alias("edge", "_s"))
        .select(key, "part", "ring", "edge", "_s.*")
    )


def point_features(df: DataFrame, properties: Sequence[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One GeoJSON Feature text per row (``feature``); null properties are kept."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return df.withColumn("feature", F.to_json(feature, {"ignoreNullFields": "false"}))


def write_features(df: DataFrame, path: str, properties: Sequence[str]) -> None:
    """One feature per line, written in parallel (newline-delimited GeoJSON)."""
    point_features(df, properties).select("feature").write.mode("overwrite").text(path)


def feature_collections(df: DataFrame, key: str, properties: Sequence[str], id_column: str, page_size: int = 1000):
    """FeatureCollection texts per ``key``, paged by id: a page holds at most ``page_size`` features.

    Ids must be whole numbers and unique, which bounds every page however many features a key has.
    """
    page = F.floor(F.col(id_column) / page_size)
    lines = point_features(df, properties).withColumn("page", page)
    ordered = F.array_sort(F.collect_list(F.struct(id_column, "feature")))
    body = F.array_join(F.transform(ordered, lambda x: x["feature"]), ",")
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}"))
    return lines.groupBy(key, "page").agg(F.count(F.lit(1)).alias("n_features"), text.alias("collection"))
