"""District coverage: percentages, roll-ups, name join, display classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinlens.functions.text import name_key
from basinlens.operators.common import latest_by_key


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coverage_pct(geotagged="geotagged_works", total="total_works") -> Column:
    """Share with one decimal (halves to even), at most 100; 0 when there are no works."""
    g, t = _col(geotagged).cast("double"), _col(total).cast("double")
    return F.when(t == 0, 0.0).otherwise(F.least(F.bround(F.try_divide(g, t) * 100, 1), F.lit(100.0)))


def state_totals(coverage: DataFrame) -> DataFrame:
    """Sums per state and the exact (unrounded, unclamped) share, best first."""
    sums = coverage.groupBy("state").agg(
        F.sum("total_works").alias("total_works"), F.sum("geotagged_works").alias("geotagged_works")
    )
    pct = F.coalesce(F.try_divide(F.col("geotagged_works").cast("double"), F.col("total_works")) * 100, F.lit(0.0))
    return sums.withColumn("pct", pct).orderBy(F.desc("pct"), "state")


def drilldown_totals(coverage: DataFrame, levels=("state", "district")) -> DataFrame:
    """National, state and district totals from one rollup; ``level`` counts the named keys."""
    rolled = coverage.rollup(*levels).agg(
        F.grouping_id().alias("_g"),
        F.sum("total_works").alias("total_works"),
        F.sum("geotagged_works").alias("geotagged_works"),
    )
    level = F.lit(len(levels)) - F.bit_count("_g")
    return rolled.select(*levels, level.cast("int").alias("level"), "total_works", "geotagged_works")


def join_boundaries(
    coverage: DataFrame, boundaries: DataFrame, match_on_state: bool = False
) -> DataFrame:
    """Coverage rows with the boundary of the same normalised name; unmatched rows stay.

    ``boundaries``: pos, district, state, boundary_id.  Of boundaries with one name the
    last (by ``pos``) is used.  ``match_on_state`` also compares the state's name.
    """
    keys = ["_key", "_state"] if match_on_state else ["_key"]
    named = boundaries.select(
        name_key("district").alias("_key"),
        (name_key("state") if match_on_state else F.lit(None).cast("string")).alias("_state"),
        "pos",
        "boundary_id",
    )
    last = latest_by_key(named, keys, ["pos"]).select(*keys, "boundary_id")
    left = coverage.withColumn("_key", name_key("district"))
    if match_on_state:
        left = left.withColumn("_state", name_key("state"))
    joined = left.join(last, keys, "left").drop(*keys)
    return joined.withColumn("matched", F.col("boundary_id").isNotNull())


def coverage_table(coverage: DataFrame, boundaries: DataFrame, match_on_state: bool = False) -> DataFrame:
    """Every district, best coverage first, unmatched ones flagged."""
    joined = join_boundaries(coverage, boundaries, match_on_state)
    return joined.withColumn("coverage_pct", coverage_pct()).orderBy(F.desc("coverage_pct"), "district")


def choropleth_class(pct="coverage_pct") -> Column:
    """Lower stop (0, 25, 50, 75 or 100) of the colour ramp; null without data."""
    return (F.floor(F.least(F.greatest(_col(pct), F.lit(0.0)), F.lit(100.0)) / 25) * 25).cast("int")
