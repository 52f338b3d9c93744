"""Treated-versus-control effect of a project, with a bootstrap over control polygons.

Series are long tables: unit_id, year, value (plus optional group columns such as the
index name in ``by``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinlens import constants as C
from basinlens.operators.common import attach_scalars, global_row_number, sized_join
from basinlens.session import cut_lineage


def control_mean(controls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over the controls that have the year; null values are skipped."""
    return controls.where("value is not null").groupBy(*by, "year").agg(F.avg("value").alias("control"))


def treated_control_gap(treated: DataFrame, controls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gap in the years both sides have.  ``treated``: year, value."""
    mean = control_mean(controls, by)
    own = treated.select(*by, "year", F.col("value").alias("treated")).where("treated is not null")
    return own.join(mean, [*by, "year"]).withColumn("gap", F.col("treated") - F.col("control"))


def _effect_columns(start_year: int, years: bool) -> list[Column]:
    pre, post = F.col("year") < start_year, F.col("year") >= start_year
    out = [F.avg(F.when(pre, F.col("gap"))).alias("_pre"), F.avg(F.when(post, F.col("gap"))).alias("_post")]
    if years:  # a handful of distinct years per series
        out += [
            F.array_sort(F.collect_set(F.when(pre, F.col("year")))).alias("pre_years"),
            F.array_sort(F.collect_set(F.when(post, F.col("year")))).alias("post_years"),
        ]
    return out


def pre_post_effect(gap: DataFrame, start_year: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean gap before and from ``start_year``; all null, with a note, when one side has no year."""
    sides = gap.groupBy(*by).agg(*_effect_columns(start_year, years=True))
    both = F.col("_pre").isNotNull() & F.col("_post").isNotNull()
    return sides.select(
        *by,
        F.when(both, F.col("_pre")).alias("pre_mean_gap"),
        F.when(both, F.col("_post")).alias("post_mean_gap"),
        F.when(both, F.col("_post") - F.col("_pre")).alias("effect"),
        "pre_years",
        "post_years",
        F.when(~both, F.lit(C.NOTE_FEW_YEARS)).alias("note"),
    )


def number_units(controls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Control units of each group with a dense index ``k`` from 0 in id order, and the group's number of units."""
    units = controls.select(*by, "unit_id").distinct()
    numbered = global_row_number(units, [F.asc(c) for c in (*by, "unit_id")], "_at", start=0)
    groups = numbered.groupBy(*by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_units"))
    joined = sized_join(numbered, groups, by) if by else attach_scalars(numbered, groups)
    return joined.select(*by, "unit_id", (F.col("_at") - F.col("_first")).alias("k"), "_units")


def drawn_times(draws: Sequence[int], units: int, seed: int) -> np.ndarray:
    """(draws, units): how often each resample of ``units`` draws with replacement holds each unit.

    Draw ``i`` of resample ``b`` is the first 32 bits of md5("seed-b-i") modulo ``units``, so
    every engine and every rerun draws the same units, and a group's draws depend on its own
    units alone.
    """
    times = np.zeros((len(draws), units), dtype=np.float64)
    for row, b in enumerate(draws):
        start = hashlib.md5(f"{seed}-{b}-".encode(), usedforsecurity=False)
        for at in range(0, units, 65_536):
            first = []
            for i in range(at, min(units, at + 65_536)):
                digest = start.copy()
                digest.update(b"%d" % i)
                first.append(digest.digest()[:4])
            drawn = np.frombuffer(b"".join(first), dtype=">u4").astype(np.int64) % units
            times[row] += np.bincount(drawn, minlength=units)
    return times


def _resample(parts: Iterator[pd.DataFrame], by: list[str], start_year: int, draws: int, seed: int, per_task: int) -> Iterator[pd.DataFrame]:
    """Effects of a set of resamples: its matrix of draws times the units' values, block of units by block."""

    def effects(key: tuple, state: dict) -> pd.DataFrame:
        years, treated = state["years"], state["treated"]
        with np.errstate(invalid="ignore", divide="ignore"):
            gap = treated - state["sum"] / state["n"]
        held = state["n"] > 0
        sides = []
        for side in (years >= start_year, years < start_year):
            n = (held & side).sum(axis=1)
            total = np.where(held & side, gap, 0.0).sum(axis=1)
            sides.append(np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0))
        effect = sides[0] - sides[1]
        rows = pd.DataFrame({"b": state["draws"], "effect": effect})
        for name, value in zip(by, key, strict=False):
            rows[name] = value
        return rows[np.isfinite(effect)][[*by, "b", "effect"]]

    current, state = None, {}
    for part in parts:
        for key, rows in part.groupby([*by, "_set"], sort=False, dropna=False):
            if key != current:
                if current is not None:
                    yield effects(current, state)
                first = rows.iloc[0]
                some = np.arange(first["_set"] * per_task, min(draws, (first["_set"] + 1) * per_task))
                years, treated = np.array(first["_years"]), np.array(first["_treated"], dtype=float)
                empty = np.zeros((len(some), len(years)))
                state = {"draws": some, "times": drawn_times(some.tolist(), int(first["_units"]), seed), "years": years, "treated": treated, "sum": empty, "n": empty.copy()}
                current = key
            values = np.array(rows["_values"].tolist(), dtype=float)  # null: no value in that year
            times = state["times"][:, rows["k"].to_numpy()]
            state["sum"] += times @ np.nan_to_num(values)
            state["n"] += times @ np.isfinite(values).astype(float)
    if current is not None:
        yield effects(current, state)


def bootstrap_effects(
    treated: DataFrame,
    controls: DataFrame,
    start_year: int,
    draws: int = C.BOOTSTRAP_DRAWS,
    seed: int = 42,
    by: Sequence[str] = (),
    per_task: int = 20,
) -> DataFrame:
    """(by, b, effect) of every resample with years on both sides.

    Years the treated series lacks are dropped first, and several rows of a unit and year
    count as their mean.  A mean over a resample is the mean over its draws: its times a
    unit was drawn, as a row of a matrix, times the matrix of units' values by year.  A task
    has ``per_task`` resamples of one group and takes the units in blocks.
    """
    units = number_units(controls, by)
    own = treated.select(*by, "year", F.col("value").alias("treated")).where("treated is not null")
    own = own.groupBy(*by, "year").agg(F.first("treated").alias("treated"))
    years = own.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("year", "treated"))).alias("_own"))
    values = controls.where("value is not null").groupBy(*by, "unit_id", "year").agg(F.avg("value").alias("value"))
    series = values.groupBy(*by, "unit_id").agg(F.map_from_entries(F.collect_list(F.struct("year", "value"))).alias("_by_year"))
    known = series.join(units, [*by, "unit_id"])
    rows = known.join(years, list(by)) if by else attach_scalars(known, years)
    rows = rows.select(
        *by,
        "k",
        "_units",
        F.col("_own.year").alias("_years"),
        F.col("_own.treated").alias("_treated"),
        F.transform("_own", lambda y: F.col("_by_year")[y["year"]]).alias("_values"),
    )
    sets = F.sequence(F.lit(0), F.lit((draws - 1) // per_task))
    # few values mean much work here, so small partitions must not be put together
    tasks = int(treated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_set", F.explode(sets)).repartition(tasks, *by, "_set").sortWithinPartitions(*by, "_set", "k")
    fields = "".join(f"{treated.schema[c].simpleString().replace(':', ' ')}, " for c in by)
    run = partial(_resample, by=list(by), start_year=start_year, draws=draws, seed=seed, per_task=per_task)
    return dealt.mapInPandas(run, f"{fields}b bigint, effect double")


def percentile_bounds(effects: DataFrame, ci: float = C.BOOTSTRAP_CI, by: Sequence[str] = ()) -> DataFrame:
    """Interval bounds by position in the sorted effects (as many as there are draws)."""
    alpha = (1.0 - ci) / 2.0
    sorted_effects = F.array_sort(F.collect_list("effect"))
    arrays = effects.groupBy(*by).agg(sorted_effects.alias("_e")).withColumn("_m", F.size("_e"))
    low = F.floor(F.lit(alpha) * F.col("_m")).cast("int")
    high = F.greatest(F.floor(F.lit(1.0 - alpha) * F.col("_m")).cast("int") - 1, low)
    return arrays.select(
        *by,
        F.get("_e", low).alias("ci_low"),
        F.get("_e", high).alias("ci_high"),
        F.col("_m").alias("n_valid_draws"),
    )


def bootstrap_did(
    treated: DataFrame,
    controls: DataFrame,
    start_year: int,
    draws: int = C.BOOTSTRAP_DRAWS,
    ci: float = C.BOOTSTRAP_CI,
    seed: int = 42,
    by: Sequence[str] = (),
) -> DataFrame:
    """Point effect from all controls plus its bootstrap interval, one row per group in ``by``.

    Missing controls or too few years give nulls with a note, never an error.
    """
    treated, controls = cut_lineage(treated), cut_lineage(controls)  # small next to the pixels they came from
    groups = treated.select(*by).distinct() if by else treated.sparkSession.range(1).select()
    gap = treated_control_gap(treated, controls, by)
    point = pre_post_effect(gap, start_year, by)
    bounds = percentile_bounds(bootstrap_effects(treated, controls, start_year, draws, seed, by), ci, by)
    size = controls.groupBy(*by).agg(F.count_distinct("unit_id").alias("n_control_polygons"))
    if by:
        rows = groups.join(point, list(by), "left").join(bounds, list(by), "left").join(size, list(by), "left")
    else:  # every part is a single row
        rows = attach_scalars(attach_scalars(attach_scalars(groups, point), bounds), size)
    none = F.coalesce(F.col("n_control_polygons"), F.lit(0)) == 0
    note = F.when(none, F.lit(C.NOTE_NO_CONTROLS)).when(F.col("ci_low").isNull(), F.lit(C.NOTE_NO_DRAWS))
    return rows.select(
        *by,
        "effect",
        "ci_low",
        "ci_high",
        F.lit(draws).alias("n_bootstrap"),
        F.lit(ci).alias("ci"),
        F.coalesce("n_control_polygons", F.lit(0)).alias("n_control_polygons"),
        "pre_mean_gap",
        "post_mean_gap",
        "pre_years",
        "post_years",
        F.coalesce(note, F.col("note")).alias("note"),
    )


def effect_series(treated: DataFrame, controls: DataFrame, rainfall: DataFrame, years: DataFrame, by: Sequence[str] = ()):
    """Per year: treated, control mean and rainfall, nulls kept.  ``years``: by + year."""
    own = treated.select(*by, "year", F.col("value").alias("treated"))
    mean = control_mean(controls, by)
    return (
        years.join(own, [*by, "year"], "left")
        .join(mean, [*by, "year"], "left")
        .join(rainfall.select("year", "rainfall_mm"), "year", "left")
        .select(*by, "year", "treated", "control", "rainfall_mm")
    )
