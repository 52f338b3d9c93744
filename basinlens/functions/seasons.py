"""Dry-season windows (1 November to the end of February, named by the November)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def season_start(year: Column) -> Column:
    return F.make_date(year, F.lit(11), F.lit(1))


def season_end(year: Column) -> Column:
    return F.last_day(F.make_date(year + 1, F.lit(2), F.lit(1)))


def dry_season_windows(spark: SparkSession, start_year: int, end_year: int) -> DataFrame:
    year = F.col("id").cast("int")
    return spark.range(start_year, end_year + 1).select(
        year.alias("year"), season_start(year).alias("start"), season_end(year).alias("end")
    )


def season_label(when, include_last_day: bool = True) -> Column:
    """Season year of a date; null outside November–February.

    Equals a join with the window table, without the join.  Image filters use
    half-open windows: pass ``include_last_day=False`` for those.
    """
    when = F.col(when) if isinstance(when, str) else when
    month = F.month(when)
    label = F.when(month >= 11, F.year(when)).when(month <= 2, F.year(when) - 1)
    if include_last_day:
        return label
    return F.when(F.to_date(when) != season_end(label), label)
