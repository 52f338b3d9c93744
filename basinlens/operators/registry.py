"""Programme registry: report tables to typed rows, categories, statuses, backlogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinlens import constants as C
from basinlens.functions.text import query_param, whole_number
from basinlens.operators.common import attach_scalars


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- typed rows by column index ---------------------------------------------------
# Input of the three extractors: rows of ``sources.report_html.table_rows`` -
# doc, row, group, cells array<struct<text,href>>.


def _cell(i: int) -> Column:
    return F.col("cells")[i]["text"]


def _numbers(fields: dict[str, int]) -> list[Column]:
    return [whole_number(_cell(i)).alias(name) for name, i in fields.items()]


# fixed values: column positions of the three report levels
DISTRICT_COLUMNS = {
    "total_projects": 2,
    "nrm_total": 3,
    "epa_total": 7,
    "livelihood_total": 11,
    "production_total": 15,
    "total_work_codes": 19,
    "geotagged_work_codes": 20,
    "non_geotagged_work_codes": 21,
}
PROJECT_COLUMNS = {
    "nrm_total": 2,
    "epa_total": 6,
    "livelihood_total": 10,
    "production_total": 14,
    "total_work_codes": 18,
    "geotagged_work_codes": 19,
    "non_geotagged_work_codes": 20,
}


def district_rows(rows: DataFrame, district: str | None = None) -> DataFrame:
    """District level (22 columns); with ``district`` only the first row of that name, any case."""
    name = F.trim(_cell(1))
    full = rows.where(F.size("cells") >= 22)
    if district is not None:
        full = full.where(F.upper(name) == district.upper()).orderBy("doc", "row").limit(1)
    return full.select(
        "doc",
        "row",
        name.alias("district"),
        query_param(F.col("cells")[1]["href"], "dcode").try_cast("int").alias("dcode"),
        *_numbers(DISTRICT_COLUMNS),
    )


def project_rows(rows: DataFrame) -> DataFrame:
    """Project level (21 columns); rows without a project id in their link are skipped."""
    href = F.col("cells")[1]["href"]
    full = rows.where((F.size("cells") >= 21) & query_param(href, "projid").isNotNull())
    return full.select(
        "doc",
        "row",
        query_param(href, "projid").try_cast("int").alias("project_id"),
        F.coalesce(query_param(href, "projname"), F.trim(_cell(1))).alias("project_name"),
        *_numbers(PROJECT_COLUMNS),
    )


def workcode_rows(rows: DataFrame) -> DataFrame:
    """Work-code level (7 columns) with category and the three stage statuses."""
    full = rows.where((F.size("cells") >= 7) & (F.trim(_cell(1)) != ""))
    base = full.select(
        "doc",
        "row",
        "group",
        F.trim(_cell(1)).alias("work_code"),
        F.trim(_cell(2)).alias("head"),
        F.trim(_cell(3)).alias("activity"),
        *[_cell(4 + i).alias(f"_{stage}") for i, stage in enumerate(("pre", "mid", "post"))],
    )
    return base.select(
        "doc",
        "row",
        "group",
        "work_code",
        "head",
        "activity",
        activity_category("activity").alias("category"),
        *[status_display(f"_{s}").alias(f"{s}_status") for s in ("pre", "mid", "post")],
        *[status_slug(f"_{s}").alias(f"{s}_slug") for s in ("pre", "mid", "post")],
    )


# --- categories and statuses --------------------------------------------------------


def activity_category(activity="activity") -> Column:
    """Category of the first keyword the activity contains."""
    text = F.lower(_col(activity))
    out = None
    for keyword, code in C.ACTIVITY_KEYWORDS:
        out = F.when(text.contains(keyword), code) if out is None else out.when(text.contains(keyword), code)
    return out.otherwise(C.DEFAULT_CATEGORY)


def status_slug(status) -> Column:
    """Blank, one known word, several known words, or something else."""
    text = F.lower(F.trim(F.coalesce(_col(status), F.lit(""))))
    found = [F.when(text.contains(word), F.lit(slug)) for word, slug in C.STATUS_WORDS.items()]
    words = F.filter(F.array(*found), lambda w: w.isNotNull())
    return (
        F.when(text == "", "not_submitted")
        .when(F.size(words) > 1, "mixed")
        .when(F.size(words) == 1, words[0])
        .otherwise("other")
    )


def status_display(status) -> Column:
    text = F.trim(F.coalesce(_col(status), F.lit("")))
    return F.when(text == "", C.BLANK_STATUS_DISPLAY).otherwise(text)


# --- aggregates -----------------------------------------------------------------------


def share_pct(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, halves to even; 0 for an empty whole."""
    pct = F.try_divide(part.cast("double"), whole.cast("double")) * 100
    return F.coalesce(F.bround(pct, 1), F.lit(0.0))


def stage_backlog(rows: DataFrame, stages=("pre", "mid", "post")) -> DataFrame:
    """Per stage: rows in each status, their share awaiting moderation, and a sum check."""
    pairs = ", ".join(f"'{s}', {s}_slug" for s in stages)
    long = rows.selectExpr(f"stack({len(stages)}, {pairs}) as (stage, slug)")
    counts = [F.count_if(F.col("slug") == s).alias(s) for s in C.STATUS_SLUGS]
    out = long.groupBy("stage").agg(F.count(F.lit(1)).alias("total"), *counts)
    known = sum((F.col(s) for s in C.STATUS_SLUGS[1:]), F.col(C.STATUS_SLUGS[0]))
    return out.select(
        "stage",
        *C.STATUS_SLUGS,
        "total",
        share_pct(F.col("yet_to_moderate"), F.col("total")).alias("yet_to_moderate_pct"),
        (known == F.col("total")).alias("sums_to_total"),
    )


def category_breakdown(rows: DataFrame, category: str = "category") -> DataFrame:
    """Non-empty categories in code order with their share of all rows."""
    counts = rows.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("work_code_count"))
    total = counts.agg(F.sum("work_code_count").alias("total"))
    shared = attach_scalars(counts, total)
    return shared.select(
        "category", "work_code_count", share_pct(F.col("work_code_count"), F.col("total")).alias("share_pct")
    ).orderBy("category")


def unmapped_activities(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("category") == C.DEFAULT_CATEGORY).select("activity").distinct().orderBy("activity")


def focus_project(projects: DataFrame, hint: str, position=("doc", "row")) -> DataFrame:
    """First project whose name contains ``hint``."""
    return projects.where(F.col("project_name").contains(hint)).orderBy(*position).limit(1)


def programme_summary(projects: DataFrame, rows: DataFrame, hint: str, position=("doc", "row")) -> DataFrame:
    """One row: the focus project, rows seen in its table, and how many works never got a photo."""
    focus = focus_project(projects, hint, position).select("project_id", "project_name", "total_work_codes")
    seen = rows.agg(F.count(F.lit(1)).alias("geotagged_in_table"))
    return attach_scalars(focus, seen).withColumn(
        "non_geotagged", F.col("total_work_codes") - F.col("geotagged_in_table")
    )
