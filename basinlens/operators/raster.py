"""Raster-style aggregation on pixel tables: composites, zones, slope, rainfall."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basinlens import constants as C
from basinlens.functions.pixels import is_clear, spectral_indices
from basinlens.operators.common import sized_join
from basinlens.operators.spatial import points_in_polygons
from basinlens.session import cut_lineage

INDICES = ["ndvi", "mndwi", "ndmi"]


def clear_indices(obs: DataFrame, keep: Sequence[str] = ("pixel_id", "ts")) -> DataFrame:
    """Cloud-free observations with their three indices."""
    values = [col.alias(name) for name, col in spectral_indices().items()]
    return obs.where(is_clear("qa")).select(*keep, *values)


def in_window(start, end, ts: str = "ts") -> Column:
    """Half-open image window [start, end)."""
    lo, hi = (F.lit(v) if isinstance(v, str) else v for v in (start, end))
    return (F.col(ts) >= lo.cast("date")) & (F.col(ts) < hi.cast("date"))


HOT_ROWS = 2_000_000  # observations of one pixel and window above which its median is found in steps
_STEPS = 1 << 20  # value steps per unit of an index


def median_composite(
    clear: DataFrame, keys: Sequence[str] = ("pixel_id",), hot_rows: int = HOT_ROWS, sample: float = 0.001
) -> DataFrame:
    """Per pixel (and any further key): median of each index and the number of clear images.

    A median needs a key's values in one place.  Satellite pixels have few of them, but a
    sample is looked at first, and keys that seem to hold more than ``hot_rows`` go
    through ``hot_medians``.  Both ways are exact, so a missed or extra key changes only
    where the work is done.
    """
    seen = clear.select(*keys) if sample >= 1 else clear.select(*keys).sample(sample, 17)
    hot = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows * min(sample, 1.0))
    hot = cut_lineage(hot.select(*keys))  # no more keys than the table has multiples of hot_rows
    if hot.isEmpty():
        return _plain_medians(clear, keys)
    usual = _plain_medians(sized_join(clear, hot, keys, "left_anti"), keys)
    return usual.unionByName(hot_medians(sized_join(clear, hot, keys, "left_semi"), keys))


def _plain_medians(clear: DataFrame, keys: Sequence[str]) -> DataFrame:
    medians = [F.median(i).alias(i) for i in INDICES]
    return clear.groupBy(*keys).agg(*medians, F.count("ndvi").alias("clear_obs"))


def hot_medians(clear: DataFrame, keys: Sequence[str], steps: int = _STEPS) -> DataFrame:
    """Exact medians of keys too large for one task.

    Values are counted in narrow steps first (a partial aggregation).  The running count
    of a key's steps shows which one or two hold the middle; only their values are read
    again, equal values counted together, and the middle is picked among those.
    """
    names = ", ".join(f"'{i}', {i}" for i in INDICES)
    long = clear.select(*keys, F.expr(f"stack({len(INDICES)}, {names}) as (_i, _v)")).where("_v is not null")
    by = [*keys, "_i"]
    stepped = long.withColumn("_s", F.floor(F.col("_v") * steps))
    per_step = stepped.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_n"))
    running = W.partitionBy(*by).orderBy("_s").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    placed = per_step.withColumn("_to", F.sum("_n").over(running)).withColumn("_all", F.sum("_n").over(whole))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)  # 1-based middle ranks
    before = F.col("_to") - F.col("_n")
    middle = placed.where((before < high) & (F.col("_to") >= low))
    wanted = middle.select(*by, "_s", before.alias("_before"), low.alias("_low"), high.alias("_high"))
    values = sized_join(stepped, cut_lineage(wanted), [*by, "_s"])  # at most two steps per hot key and index
    distinct = values.groupBy(*by, "_s", "_before", "_low", "_high", "_v").agg(F.count(F.lit(1)).alias("_n"))
    inside = W.partitionBy(*by, "_s").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = distinct.withColumn("_to", F.col("_before") + F.sum("_n").over(inside))
    ranked = ranked.withColumn("_from", F.col("_to") - F.col("_n"))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("_from") < F.col(rank)) & (F.col("_to") >= F.col(rank)), F.col("_v")))

    medians = ranked.groupBy(*by).agg(((at("_low") + at("_high")) / 2).alias("_m"))
    wide = medians.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_m"))).alias(i) for i in INDICES])
    counts = clear.groupBy(*keys).agg(F.count("ndvi").alias("clear_obs"))
    return wide.join(counts, list(keys)).select(*keys, *INDICES, "clear_obs")


def windowed_composites(obs: DataFrame, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """Composites of several windows in one scan and one shuffle, keyed (pixel_id, window).

    An observation enters every window that holds it, so windows may overlap.
    """
    names = F.filter(
        F.array(*[F.when(in_window(lo, hi), F.lit(name)) for name, (lo, hi) in windows.items()]),
        lambda w: w.isNotNull(),
    )
    low = min(lo for lo, _ in windows.values())
    high = max(hi for _, hi in windows.values())
    tagged = obs.where(in_window(low, high)).withColumn("window", F.explode(names))
    return median_composite(clear_indices(tagged, ("pixel_id", "window")), ("pixel_id", "window"))


def composite_change(composites: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """After minus before per pixel, and whether the pixel is water in each; pixels seen in both.

    One grouped pass over the two composites instead of joining them.
    """

    def at(window: str, name: str) -> Column:
        return F.max(F.when(F.col("window") == window, F.col(name)))

    wide = composites.where(F.col("window").isin(before, after)).groupBy("pixel_id").agg(
        *[at(w, i).alias(f"{i}_{tag}") for i in INDICES for w, tag in ((before, "b"), (after, "a"))]
    )
    seen = wide.where("ndvi_b is not null and ndvi_a is not null")
    return seen.select(
        "pixel_id",
        *[(F.col(f"{i}_a") - F.col(f"{i}_b")).alias(f"{i}_change") for i in INDICES],
        (F.col("mndwi_b") > 0).alias("water_before"),
        (F.col("mndwi_a") > 0).alias("water_after"),
    )


def zonal_stats(composites: DataFrame, membership: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per zone: mean indices, mean clear-image count, share of water pixels.

    ``membership`` holds pixel_id and the zone columns in ``keys``; further keys of the
    composites (such as the window) may be listed in ``keys`` too.
    """
    joined = composites.join(membership, "pixel_id")
    return joined.groupBy(*keys).agg(
        *[F.avg(i).alias(i) for i in INDICES],
        F.avg("clear_obs").alias("clear_obs"),
        F.avg((F.col("mndwi") > 0).cast("int")).alias("water_fraction"),
        F.count(F.lit(1)).alias("pixels"),
    )


def point_did(zones: DataFrame, key: str) -> DataFrame:
    """Per site: (treated after - before) - (control after - before) of each index.

    ``zones``: key, zone (treated/control), window (before/after) + zonal statistics.  A
    statistic that is missing counts as 0; too few clear images mark the row.
    """
    names = [*INDICES, "water_fraction"]

    def at(zone: str, window: str, name: str) -> Column:
        here = (F.col("zone") == zone) & (F.col("window") == window)
        return F.coalesce(F.max(F.when(here, F.col(name))), F.lit(0.0))

    def did(name: str) -> Column:
        treated = at("treated", "after", name) - at("treated", "before", name)
        return treated - (at("control", "after", name) - at("control", "before", name))

    corners = [(z, w) for z in ("treated", "control") for w in ("before", "after")]
    fewest = F.least(*[at(z, w, "clear_obs") for z, w in corners])
    return zones.groupBy(key).agg(
        *[did(n).alias(f"did_{n}") for n in names],
        fewest.alias("min_clear_obs"),
        (fewest < C.MIN_CLEAR_OBS).alias("low_confidence"),
    )


def seasonal_rainfall(rain: DataFrame, membership: DataFrame, zone: str, window: Column | None = None) -> DataFrame:
    """Sum over days per cell, then mean over the cells of a zone.  ``rain``: cell_id, day, mm."""
    days = rain if window is None else rain.where(window)
    per_cell = days.groupBy("cell_id").agg(F.sum("mm").alias("mm"))
    return per_cell.join(membership, "cell_id").groupBy(zone).agg(F.avg("mm").alias("rain_mm"))


def monsoon_rainfall(rain: DataFrame, membership: DataFrame, zone: str) -> DataFrame:
    """1 June to 29 September per year (the window's last day is open), per zone."""
    month_day = F.month("day") * 100 + F.dayofmonth("day")
    season = rain.where((month_day >= 601) & (month_day < 930)).withColumn("year", F.year("day"))
    per_cell = season.groupBy("cell_id", "year").agg(F.sum("mm").alias("mm"))
    return per_cell.join(membership, "cell_id").groupBy(zone, "year").agg(F.avg("mm").alias("rain_mm"))


def label_pixels(pixels: DataFrame, edges: DataFrame, order: DataFrame, cell_size: float, key: str = "polygon_id"):
    """One polygon per pixel centre; where polygons overlap the last in ``order`` (key, pos) wins."""
    hits = points_in_polygons(pixels, edges, cell_size, key).join(order.select(key, "pos"), key)
    carried = [c for c in pixels.columns if c != "pixel_id"]
    return (
        hits.groupBy("pixel_id")
        .agg(F.max_by(F.struct(key, *carried), "pos").alias("_w"))
        .select("pixel_id", *[F.col(f"_w.{c}").alias(c) for c in (key, *carried)])
    )


def class_shares(labelled: DataFrame, polygons: DataFrame, key: str = "polygon_id", class_col: str = "lc") -> DataFrame:
    """Pixel count and class shares per polygon; polygons without pixels get zeros."""
    classes = {
        "crop_share": C.CLASS_CROP,
        "built_up_share": C.CLASS_BUILT,
        "water_share": C.CLASS_WATER,
        "tree_share": C.CLASS_TREE,
    }
    counts = labelled.groupBy(key).agg(
        F.count(F.lit(1)).alias("pixel_count"),
        *[(F.count_if(F.col(class_col) == code) / F.count(F.lit(1))).alias(name) for name, code in classes.items()],
    )
    filled = polygons.select(key).join(counts, key, "left")
    return filled.select(
        key,
        F.coalesce("pixel_count", F.lit(0)).alias("pixel_count"),
        *[F.coalesce(name, F.lit(0.0)).alias(name) for name in classes],
    )


TILE = 256  # pixels along a tile's side


def _gradient(z: np.ndarray, seen: np.ndarray, axis: int, size: float) -> np.ndarray:
    """Differences along an axis of the inner pixels of a tile with a border of one: central, one-sided where a neighbour is missing."""
    pick = [slice(1, -1), slice(1, -1)]

    def moved(values: np.ndarray, by: int) -> np.ndarray:
        place = list(pick)
        place[axis] = slice(1 + by, values.shape[axis] - 1 + by)
        return values[tuple(place)]

    own, z0, z1, before, after = moved(z, 0), moved(z, -1), moved(z, 1), moved(seen, -1), moved(seen, 1)
    one_sided = np.where(after, (z1 - own) / size, np.where(before, (own - z0) / size, np.nan))
    return np.where(before & after, (z1 - z0) / (2 * size), one_sided)


def _tile_slopes(rows: pa.Table, dx: float, dy: float, side: int) -> pa.Table:
    r, c, z = (rows.column(n).to_numpy() for n in ("r", "c", "_z"))
    i, j = r - rows.column("_tr")[0].as_py() * side + 1, c - rows.column("_tc")[0].as_py() * side + 1
    heights, seen = np.full((side + 2, side + 2), np.nan), np.zeros((side + 2, side + 2), dtype=bool)
    heights[i, j], seen[i, j] = z, True
    own = (i >= 1) & (i <= side) & (j >= 1) & (j <= side)
    slope = np.degrees(np.arctan(np.hypot(_gradient(heights, seen, 1, dx), _gradient(heights, seen, 0, dy))))[i[own] - 1, j[own] - 1]
    kept = rows.filter(pa.array(own)).drop_columns(["_z", "_tr", "_tc"])
    return kept.append_column("slope_deg", pa.array(slope, pa.float64(), mask=np.isnan(slope)))


def slope_degrees(
    dem: DataFrame, step_x_deg: float, step_y_deg: float, mean_lat_deg: float, tile: Sequence[str] = (), side: int = TILE
) -> DataFrame:
    """Slope per pixel from elevation: central differences, one-sided at the grid's edge.

    ``dem``: tile columns, r, c, z, one row per pixel.  No-data heights are null and make
    the slopes that use them null.  The grid is cut into squares that carry a copy of the
    pixels around them, so one shuffle serves both directions and a task holds one square.
    """
    dx = step_x_deg * C.M_PER_DEG_LON_EQUATOR * math.cos(math.radians(mean_lat_deg))
    dy = step_y_deg * C.M_PER_DEG_LAT
    z = F.when(F.col("z") >= C.ELEVATION_NODATA_BELOW, F.col("z")).cast("double")

    def square(r_by: int, c_by: int) -> Column:
        return F.struct(F.floor((F.col("r") + r_by) / side).alias("_tr"), F.floor((F.col("c") + c_by) / side).alias("_tc"))

    squares = F.array_distinct(F.array(*[square(*by) for by in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))]))
    dealt = dem.withColumn("_z", z).select("*", F.inline(squares))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dem.schema)
    squares_of = dealt.groupBy(*tile, "_tr", "_tc")
    return squares_of.applyInArrow(lambda rows: _tile_slopes(rows, dx, dy, side), f"{fields}, slope_deg double")


def mean_slope(slopes: DataFrame, labels: DataFrame, key: str = "polygon_id") -> DataFrame:
    """Mean slope per polygon, null pixels ignored; ``labels``: pixel_id, key."""
    return slopes.join(labels, "pixel_id").groupBy(key).agg(F.avg("slope_deg").alias("mean_slope_deg"))


def annual_series(obs: DataFrame, membership: DataFrame, zone: str) -> DataFrame:
    """Dry-season mean indices per zone and season year: one scan for all years."""
    from basinlens.functions.seasons import season_label

    label = season_label("ts", include_last_day=False)
    seasons = obs.withColumn("year", label).where("year is not null")
    comp = median_composite(clear_indices(seasons, ("pixel_id", "year")), ("pixel_id", "year"))
    return zonal_stats(comp, membership, [zone, "year"])
