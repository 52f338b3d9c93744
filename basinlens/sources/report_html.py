"""Cached report pages to table rows and links, with built-in regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinlens.functions.text import collapse_spaces, unescape
from basinlens.operators.common import forward_fill

BODY = r"(?is)<tbody\b[^>]*>(.*?)(?:</tbody>|\z)"
ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
CELL = r"(?is)<td\b([^>]*)>(.*?)</td>"
LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""
COLSPAN = r"""(?is)\bcolspan\s*=\s*["']?[^"'\s>]"""


def _all(text, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def cell_text(html: Column) -> Column:
    return collapse_spaces(unescape(F.regexp_replace(html, r"<[^>]*>", "")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``doc, html``: whole files as rows; ``doc`` is the whole path, as folders may hold files of one name."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("html"))


def raw_rows(pages: DataFrame) -> DataFrame:
    """``doc, row, header, cells``: rows inside table bodies that have data cells.

    A row whose only cell spans columns is a section header.
    """
    bodies = F.flatten(F.transform(_all("html", BODY, 1), lambda b: _all(b, ROW, 1)))
    rows = pages.select("doc", F.posexplode(bodies).alias("row", "_tr"))
    split = rows.select("doc", "row", _all("_tr", CELL, 1).alias("_attrs"), _all("_tr", CELL, 2).alias("_cells"))
    cells = F.transform(
        "_cells",
        lambda c: F.struct(
            cell_text(c).alias("text"),
            unescape(F.try_element_at(_all(c, LINK, 1), F.lit(-1))).alias("href"),
        ),
    )
    is_header = (F.size("_cells") == 1) & F.col("_attrs")[0].rlike(COLSPAN)
    typed = split.where(F.size("_cells") > 0).withColumn("cells", cells)
    header = F.when(is_header, F.nullif(F.col("cells")[0]["text"], F.lit("")))
    return typed.select("doc", "row", is_header.alias("is_header"), header.alias("header"), "cells")


def table_rows(pages: DataFrame) -> DataFrame:
    """``doc, row, group, cells``: data rows with the section header above them."""
    filled = forward_fill(raw_rows(pages), "header", "row", ["doc"], name="group")
    return filled.where(~F.col("is_header")).select("doc", "row", "group", "cells")


def list_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, pos, href, text`` of the links that make up list items."""
    pattern = r"(?is)<li[^>]*>\s*<a\b[^>]*?\bhref=\"([^\"]*)\"[^>]*>(.*?)</a>"
    pairs = F.arrays_zip(_all(html, pattern, 1).alias("href"), _all(html, pattern, 2).alias("text"))
    items = pages.select(key, F.posexplode(pairs).alias("pos", "_i"))
    return items.select(key, "pos", unescape(F.col("_i.href")).alias("href"), cell_text(F.col("_i.text")).alias("text"))
