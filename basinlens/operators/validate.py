"""Schema rules on incoming rows: every row is kept, either as valid or with its reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinlens import constants as C


def _reasons(*rules: tuple[Column, str]) -> Column:
    """Array of the texts whose condition holds (a null condition does not hold)."""
    return F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]), lambda x: x.isNotNull())


def validate_records(df: DataFrame) -> DataFrame:
    """Field-record rules; adds ``errors`` and fills ``photo_source``.

    A missing ``is_synthetic`` counts as false.  A real record without a photo
    source gets the default; a synthetic one needs one of the synthetic sources.
    """
    synthetic = F.coalesce(F.col("is_synthetic"), F.lit(False))
    known = F.coalesce(F.col("category").isin(C.CATEGORY_CODES), F.lit(False))
    source_ok = F.coalesce(F.col("photo_source").isin(C.PHOTO_SOURCES_SYNTHETIC), F.lit(False))
    required = [(F.col(c).isNull(), f"{c} is required") for c in ("mws_id", "category", "activity", "lat", "lon") if c in df.columns]
    errors = _reasons(
        *required,
        (F.col("category").isNotNull() & ~known, "category is not one of the fixed codes"),
        (synthetic & ~source_ok, "photo_source is required for synthetic records"),
    )
    source = F.when(~synthetic, F.coalesce(F.col("photo_source"), F.lit(C.PHOTO_SOURCE_DEFAULT))).otherwise(
        F.col("photo_source")
    )
    return df.withColumn("errors", errors).withColumn("is_synthetic", synthetic).withColumn("photo_source", source)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``errors``)."""
    return df.where(F.size("errors") == 0).drop("errors"), df.where(F.size("errors") > 0)


def check_reference(df: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose parent exists, rows whose parent does not)."""
    ids = parents.select(key)
    return df.join(ids, key, "left_semi"), df.join(ids, key, "left_anti")


def validate_provenance(df: DataFrame) -> DataFrame:
    """A synthetic register entry that names a photo source must name an allowed one."""
    bad = F.col("is_synthetic") & F.col("photo_source").isNotNull() & ~F.col("photo_source").isin(C.PHOTO_SOURCES_ALL)
    return df.withColumn("errors", _reasons((bad, "photo_source is not an allowed value")))


def provenance_kind(placeholder, is_synthetic=None) -> Column:
    """``placeholder`` / ``synthetic`` / ``real``, in that order of precedence."""
    col = F.col(placeholder) if isinstance(placeholder, str) else placeholder
    kind = F.when(col, F.lit("placeholder"))
    if is_synthetic is not None:
        kind = kind.when(F.col(is_synthetic) if isinstance(is_synthetic, str) else is_synthetic, F.lit("synthetic"))
    return kind.otherwise(F.lit("real"))


def boundary_unconfirmed(source) -> Column:
    """True while the boundary's source text says a person has yet to confirm it."""
    col = F.col(source) if isinstance(source, str) else source
    return F.coalesce(col.contains("pending_human_confirmation"), F.lit(False))


def resolve_manifest(manifests: DataFrame, boxes: DataFrame, layers: Sequence[str] = tuple(C.THEMATIC_LAYERS)) -> DataFrame:
    """One row per known manifest layer, with inherited placeholder flag and bounds.

    ``manifests``: mws_id, placeholder, layers map<string,struct<type,path,bounds,placeholder>>.
    ``boxes``: mws_id, xmin, ymin, xmax, ymax, used where an entry has no bounds.
    """
    entries = manifests.select("mws_id", F.col("placeholder").alias("_whole"), F.explode("layers").alias("layer", "e"))
    known = entries.where(F.col("layer").isin(list(layers)))
    joined = known.join(boxes, "mws_id", "inner")
    box = F.array("xmin", "ymin", "xmax", "ymax")
    kind = F.when(F.col("e.type") == "raster_png", "raster").when(F.col("e.type") == "geojson", "vector")
    return joined.select(
        "mws_id",
        "layer",
        kind.alias("kind"),
        F.coalesce(F.col("e.bounds"), box).alias("bounds"),
        F.coalesce(F.col("e.placeholder"), F.col("_whole"), F.lit(False)).alias("placeholder"),
        F.col("e.path").alias("path"),
        F.when(kind.isNull(), F.concat(F.lit("unrecognised type "), F.col("e.type"))).alias("error"),
    )
