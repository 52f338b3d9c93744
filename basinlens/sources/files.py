"""Typed file scans and table writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basinlens.functions.text import rewrite_prefix
from basinlens.operators.evaluation import accuracy_status

# fixed values: column order of the registry file
REGISTRY_COLUMNS = [
    "work_code", "head", "activity", "category", "pre_status", "mid_status", "post_status", "source_url", "retrieved_at",
]

SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("n_photos", T.IntegerType()),
        T.StructField("n_correct", T.IntegerType()),
        T.StructField("n_errors", T.IntegerType()),
        T.StructField("n_schema_invalid_responses", T.IntegerType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("is_full_dataset", T.BooleanType()),
        T.StructField("axis_labels", T.ArrayType(T.StringType())),
        T.StructField("confusion_matrix", T.MapType(T.StringType(), T.MapType(T.StringType(), T.IntegerType()))),
    ]
)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file holding one JSON array of objects.  A missing file is an error; bad rows fail the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_lines(
    spark: SparkSession, path: str, schema: T.StructType, url_column: str | None = None, prefix: tuple[str, str] | None = None
) -> DataFrame:
    """A dump with one object per line; ``prefix`` = (old, new) start of the URLs in ``url_column``."""
    df = spark.read.schema(schema).json(path)
    if url_column and prefix:
        df = df.withColumn(url_column, rewrite_prefix(url_column, *prefix))
    return df


def read_summaries(spark: SparkSession, pattern: str, schema: T.StructType = SUMMARY_SCHEMA) -> DataFrame:
    """All summary files of a glob with ``file`` and ``accuracy_status``; no files give no rows."""
    try:
        df = spark.read.schema(schema).option("multiLine", True).json(pattern)
        df = df.select(F.col("_metadata.file_name").alias("file"), *df.columns)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        df = spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType()), *schema.fields]))
    return df.withColumn("accuracy_status", accuracy_status())


def write_registry_csv(rows: DataFrame, path: str, source_url: str, retrieved_at: str) -> None:
    out = rows.withColumn("source_url", F.lit(source_url)).withColumn("retrieved_at", F.lit(retrieved_at))
    # empty texts are written as "" and nulls as nothing; the reader tells them apart
    out.select(*REGISTRY_COLUMNS).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_registry_csv(spark: SparkSession, path: str, columns: Sequence[str] = REGISTRY_COLUMNS) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    # a null mark that no cell holds keeps "" from being read as null
    options = {"header": True, "escape": '"', "nullValue": "\\N"}
    return spark.read.schema(schema).options(**options).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def box_overlaps(box: tuple[float, float, float, float]) -> Column:
    """Predicate on plain xmin/ymin/xmax/ymax columns, which Parquet can use to skip row groups."""
    x1, y1, x2, y2 = box
    return (F.col("xmin") <= x2) & (F.col("xmax") >= x1) & (F.col("ymin") <= y2) & (F.col("ymax") >= y1)


def scan_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], columns: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(path).where(box_overlaps(box))
    return df.select(*columns) if columns else df


def write_series(series: DataFrame, path: str, meta: dict[str, str], by: Sequence[str] = ("index",)) -> None:
    """Nested result: per polygon one document with a year -> value map per index."""
    series_documents(series, meta, by).write.mode("overwrite").json(path)


def series_documents(series: DataFrame, meta: dict[str, str], by: Sequence[str] = ("index",)) -> DataFrame:
    """``polygon_id, series map<index, map<year,value>>`` plus constant columns; one entry per year."""
    per_index = series.groupBy("polygon_id", *by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("year").cast("string"), "value")))).alias("by_year")
    )
    nested = per_index.groupBy("polygon_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("_", *by), F.to_json("by_year"))))).alias("_json")
    )
    typed = F.transform_values("_json", lambda _, v: F.from_json(v, "map<string,double>"))
    return nested.select("polygon_id", typed.alias("series"), *[F.lit(v).alias(k) for k, v in meta.items()])
