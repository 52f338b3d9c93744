"""Polygon operators on an edge table.

An edge table has one row per polygon side: ``polygon_id, part, ring, edge, x1, y1,
x2, y2`` (x = longitude, y = latitude), plus whatever else the caller keeps.  Tests
use the sign of a cross product, never a division, so points on a side are
recognised exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basinlens import constants as C
from basinlens.functions.geo import cell, cell_range, haversine_m
from basinlens.operators.common import sized_join

EDGE_STRUCT = ["x1", "y1", "x2", "y2"]


def polygon_boxes(edges: DataFrame, key: str = "polygon_id") -> DataFrame:
    """Bounding box per polygon (rings are closed, so first points cover all points)."""
    return edges.groupBy(key).agg(
        F.min("x1").alias("xmin"), F.min("y1").alias("ymin"), F.max("x1").alias("xmax"), F.max("y1").alias("ymax")
    )


def polygon_area_ha(edges: DataFrame, key: str = "polygon_id", origins: DataFrame | None = None) -> DataFrame:
    """Area in hectares by the shoelace sum on a local equirectangular plane.

    Coordinates are taken relative to the polygon's box corner to keep precision;
    metres per degree of longitude use the mean latitude of the box.
    """
    box = origins if origins is not None else polygon_boxes(edges, key)
    rel = edges.join(box.select(key, "xmin", "ymin", "ymax"), key)
    twice = (F.col("x1") - F.col("xmin")) * (F.col("y2") - F.col("ymin")) - (F.col("x2") - F.col("xmin")) * (
        F.col("y1") - F.col("ymin")
    )
    # rings are grouped first: holes count against the outer ring whatever their direction
    is_hole = F.col("ring") > 0 if "ring" in edges.columns else F.lit(False)
    part = F.col("part") if "part" in edges.columns else F.lit(0)
    ring = F.col("ring") if "ring" in edges.columns else F.lit(0)
    rings = rel.groupBy(key, part.alias("_part"), ring.alias("_ring")).agg(
        F.abs(F.sum(twice)).alias("_twice"),
        F.max(is_hole).alias("_hole"),
        F.max((F.col("ymin") + F.col("ymax")) / 2).alias("_lat"),
    )
    signed = F.when(F.col("_hole"), -F.col("_twice")).otherwise(F.col("_twice"))
    scale = F.lit(C.M_PER_DEG_LAT * C.M_PER_DEG_LON_EQUATOR / 2 / 10_000) * F.cos(F.radians(F.col("_lat")))
    return rings.groupBy(key).agg(F.sum(signed * scale).alias("area_ha"))


# --- point in polygon ---------------------------------------------------------


def edge_index(edges: DataFrame, band_size: float, key: str = "polygon_id") -> DataFrame:
    """``key, yband, edges[]``: the sides met by each horizontal band of a polygon.

    A point test needs only the sides of its own band, so a polygon with many
    sides, or one that holds most points, is spread over its bands.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.withColumn("yband", F.explode(cell_range(low, high, band_size)))
    return banded.groupBy(key, "yband").agg(F.collect_list(F.struct(*EDGE_STRUCT)).alias("edges"))


def inside_edges(lon: Column, lat: Column, edges: Column) -> Column:
    """True strictly inside; a point on a side is outside.  Null edges mean outside."""

    def cross(e: Column) -> Column:
        return (e["x2"] - e["x1"]) * (lat - e["y1"]) - (lon - e["x1"]) * (e["y2"] - e["y1"])

    def on_side(e: Column) -> Column:
        return (
            (cross(e) == 0)
            & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    def crossed(e: Column) -> Column:
        upward = e["y2"] > e["y1"]
        straddles = (e["y1"] > lat) != (e["y2"] > lat)
        return straddles & (F.when(upward, cross(e) > 0).otherwise(cross(e) < 0))

    odd = F.size(F.filter(edges, crossed)) % 2 == 1
    return F.coalesce(odd & ~F.exists(edges, on_side), F.lit(False))


def flag_inside_own_polygon(
    points: DataFrame, edges: DataFrame, key: str, band_size: float, name: str = "inside", lon="lon", lat="lat"
) -> DataFrame:
    """Whether each point lies in the polygon named by its own ``key``; rows are kept one to one."""
    index = edge_index(edges, band_size, key)
    banded = points.withColumn("yband", cell(lat, band_size))
    joined = sized_join(banded, index, [key, "yband"], "left")
    return joined.select(*points.columns, inside_edges(F.col(lon), F.col(lat), F.col("edges")).alias(name))


def points_in_polygons(
    points: DataFrame, edges: DataFrame, cell_size: float, key: str = "polygon_id", lon="lon", lat="lat"
) -> DataFrame:
    """All (point, polygon) pairs with the point strictly inside: an equi-join on grid cells.

    Each horizontal band of a polygon is listed under the cells its x-range covers, so
    a point meets only polygons whose band passes through its cell.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.withColumn("ycell", F.explode(cell_range(low, high, cell_size)))
    bands = banded.groupBy(key, "ycell").agg(
        F.collect_list(F.struct(*EDGE_STRUCT)).alias("edges"),
        F.min(F.least("x1", "x2")).alias("_xlo"),
        F.max(F.greatest("x1", "x2")).alias("_xhi"),
    )
    cells = bands.withColumn("xcell", F.explode(cell_range(F.col("_xlo"), F.col("_xhi"), cell_size))).drop("_xlo", "_xhi")
    located = points.withColumn("xcell", cell(lon, cell_size)).withColumn("ycell", cell(lat, cell_size))
    pairs = sized_join(located, cells, ["xcell", "ycell"])
    return pairs.where(inside_edges(F.col(lon), F.col(lat), F.col("edges"))).select(*points.columns, key)


# --- polygon against polygon --------------------------------------------------


def _orientation(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_touch(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Closed segments share a point (crossing, touching or overlapping)."""
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    d1 = _orientation(ax1, ay1, ax2, ay2, bx1, by1)
    d2 = _orientation(ax1, ay1, ax2, ay2, bx2, by2)
    d3 = _orientation(bx1, by1, bx2, by2, ax1, ay1)
    d4 = _orientation(bx1, by1, bx2, by2, ax2, ay2)
    boxes = (
        (F.greatest(ax1, ax2) >= F.least(bx1, bx2))
        & (F.greatest(bx1, bx2) >= F.least(ax1, ax2))
        & (F.greatest(ay1, ay2) >= F.least(by1, by2))
        & (F.greatest(by1, by2) >= F.least(ay1, ay2))
    )
    return boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)


def _point_segment_sq(px, py, ax, ay, bx, by) -> Column:
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    along = (px - ax) * (bx - ax) + (py - ay) * (by - ay)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(along, length), F.lit(0.0))))
    dx, dy = px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))
    return dx * dx + dy * dy


def segment_distance_sq(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Squared planar distance of two segments."""
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    ends = F.least(
        _point_segment_sq(ax1, ay1, bx1, by1, bx2, by2),
        _point_segment_sq(ax2, ay2, bx1, by1, bx2, by2),
        _point_segment_sq(bx1, by1, ax1, ay1, ax2, ay2),
        _point_segment_sq(bx2, by2, ax1, ay1, ax2, ay2),
    )
    return F.when(segments_touch(a, b), F.lit(0.0)).otherwise(ends)


def _edges_in_cells(edges: DataFrame, key: str, prefix: str, cell_size: float, margin: float) -> DataFrame:
    """Sides listed under the grid cells that lie within ``margin`` of them: column by column, the rows that a side passes there.

    A diagonal side takes as many rows as it has cells, not as its box has.
    """
    m = F.lit(float(margin))
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    columns = edges.withColumn("xcell", F.explode(cell_range(low - m, high + m, cell_size)))
    slope = F.coalesce(F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")), F.lit(0.0))

    def height(x: Column) -> Column:
        return F.col("y1") + (F.greatest(low, F.least(high, x)) - F.col("x1")) * slope

    # the stretch within reach of the column, a little wider than rounding
    slack = F.lit(cell_size * 1e-9)
    near, far = height(F.col("xcell") * cell_size - m - slack), height((F.col("xcell") + 1) * cell_size + m + slack)
    steep = F.col("x1") == F.col("x2")
    bottom = F.when(steep, F.least("y1", "y2")).otherwise(F.least(near, far)) - m - slack
    top = F.when(steep, F.greatest("y1", "y2")).otherwise(F.greatest(near, far)) + m + slack
    named = [F.col(c).alias(f"{prefix}{c}") for c in EDGE_STRUCT]
    return columns.withColumn("ycell", F.explode(cell_range(bottom, top, cell_size))).select(
        "xcell", "ycell", F.col(key).alias(f"{prefix}id"), *named
    )


def _anchor_points(edges: DataFrame, key: str) -> DataFrame:
    """One vertex per part: enough to decide containment when no sides meet."""
    part = F.col("part") if "part" in edges.columns else F.lit(0)
    first = F.min(F.struct("x1", "y1")).alias("p")
    return edges.groupBy(F.col(key).alias("anchor_id"), part.alias("_part")).agg(first).select(
        "anchor_id", F.col("p.x1").alias("lon"), F.col("p.y1").alias("lat")
    )


def polygons_within(
    left: DataFrame, right: DataFrame, distance: float, cell_size: float, key: str = "polygon_id"
) -> DataFrame:
    """Distinct (left_id, right_id) with planar distance <= ``distance`` (same units as the edges).

    Sides meet in shared grid cells (the left side dilated by ``distance``); a polygon
    wholly inside another is found by a vertex test, both ways round.
    """
    a = _edges_in_cells(left, key, "l_", cell_size, distance)
    b = _edges_in_cells(right, key, "r_", cell_size, 0.0)
    near = segment_distance_sq([F.col(f"l_{c}") for c in EDGE_STRUCT], [F.col(f"r_{c}") for c in EDGE_STRUCT])
    close = a.hint("merge").join(b, ["xcell", "ycell"]).where(near <= F.lit(distance * distance))
    pairs = close.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))
    left_inside = points_in_polygons(_anchor_points(left, key), right, cell_size, key).select(
        F.col("anchor_id").alias("left_id"), F.col(key).alias("right_id")
    )
    right_inside = points_in_polygons(_anchor_points(right, key), left, cell_size, key).select(
        F.col(key).alias("left_id"), F.col("anchor_id").alias("right_id")
    )
    return pairs.unionByName(left_inside).unionByName(right_inside).distinct()


def neighbours(edges: DataFrame, buffer: float, cell_size: float, key: str = "polygon_id") -> DataFrame:
    """Pairs of different polygons within ``buffer`` of each other, both ways round; each is looked for once."""
    a = _edges_in_cells(edges, key, "l_", cell_size, buffer)
    b = _edges_in_cells(edges, key, "r_", cell_size, 0.0)
    near = segment_distance_sq([F.col(f"l_{c}") for c in EDGE_STRUCT], [F.col(f"r_{c}") for c in EDGE_STRUCT])
    met = a.hint("merge").join(b, ["xcell", "ycell"]).where(F.col("l_id") < F.col("r_id"))
    close = met.where(near <= F.lit(buffer * buffer)).select("l_id", "r_id")
    inside = points_in_polygons(_anchor_points(edges, key), edges, cell_size, key).where(F.col("anchor_id") != F.col(key))
    nested = inside.select(F.least("anchor_id", key).alias("l_id"), F.greatest("anchor_id", key).alias("r_id"))
    once = close.unionByName(nested).distinct()
    both = F.array(F.struct(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id")), F.struct(F.col("r_id").alias("left_id"), F.col("l_id").alias("right_id")))
    return once.select(F.inline(both))


def polygons_meeting(
    candidates: DataFrame, regions: DataFrame, cell_size: float, key: str = "polygon_id"
) -> DataFrame:
    """Distinct (left_id, right_id) of polygons that share a point."""
    return polygons_within(candidates, regions, 0.0, cell_size, key)


def ring_signs(edges: DataFrame, key: str) -> DataFrame:
    """``edges`` with ``_sign``: 1 if the ring's interior lies left of its sides, else -1.  The outside of a hole's ring is the polygon's inside."""
    part = F.col("part") if "part" in edges.columns else F.lit(0)
    ring = F.col("ring") if "ring" in edges.columns else F.lit(0)
    named = edges.withColumns({"_part": part, "_ring": ring})
    # relative to a corner of the ring, to keep precision
    corner = named.groupBy(key, "_part", "_ring").agg(F.min("x1").alias("_x"), F.min("y1").alias("_y"))
    rel = named.join(corner, [key, "_part", "_ring"])
    twice = (F.col("x1") - F.col("_x")) * (F.col("y2") - F.col("_y")) - (F.col("x2") - F.col("_x")) * (F.col("y1") - F.col("_y"))
    turned = rel.groupBy(key, "_part", "_ring").agg(F.sum(twice).alias("_twice"))
    sign = F.when(F.col("_twice") >= 0, 1).otherwise(-1) * F.when(F.col("_ring") > 0, -1).otherwise(1)
    signed = turned.select(key, "_part", "_ring", sign.alias("_sign"), F.abs(F.col("_twice") / 2).alias("_ring_area"))
    return named.join(signed, [key, "_part", "_ring"])


def _strips(sides: DataFrame, step: float, prefix: str, *kept: str) -> DataFrame:
    """Sides cut at multiples of ``step`` in x, left end first, with the sign of the area below them.

    A polygon is the signed sum of what lies below its sides: sides that run back count for
    it, sides that run forth against it (interior to the left).  Vertical sides bound nothing.
    """
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    cut = sides.where("x1 <> x2").withColumn("strip", F.explode(cell_range(low, high, step)))
    start, end = F.greatest(low, F.col("strip") * step), F.least(high, (F.col("strip") + 1) * step)

    def height(x: Column) -> Column:
        return F.col("y1") + (x - F.col("x1")) * ((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))

    sign = F.when(F.col("x1") > F.col("x2"), F.col("_sign")).otherwise(-F.col("_sign"))
    parts = {"a": start, "b": end, "ya": height(start), "yb": height(end), "s": sign}
    return cut.select("strip", *kept, *[c.alias(f"{prefix}{n}") for n, c in parts.items()]).where(F.col(f"{prefix}a") < F.col(f"{prefix}b"))


def overlap_areas(left: DataFrame, right: DataFrame, pairs: DataFrame, step: float, key: str = "polygon_id") -> DataFrame:
    """(left_id, right_id, area, share): the area that each pair of polygons has in common, in square units of the coordinates.

    Two polygons share the sum, over their pairs of sides, of the signed area below both
    sides: an integral of the lower of two lines.  Sides only meet within strips of x of
    width ``step``, which bounds the pairs and does not change the sum.  ``share`` is of the
    left polygon's own area.  Parts of one polygon must not overlap.
    """
    own = ring_signs(left, key)
    rings = own.groupBy(key, "_part", "_ring").agg(F.first("_ring_area").alias("_a"))
    size = rings.groupBy(F.col(key).alias("left_id")).agg(F.sum(F.when(F.col("_ring") > 0, -F.col("_a")).otherwise(F.col("_a"))).alias("own"))
    boxes = polygon_boxes(left, key).select(F.col(key).alias("left_id"), F.col("xmin").alias("_x0"), F.col("ymin").alias("_y0"), "xmax", "ymax")
    wanted = pairs.select("left_id", "right_id").join(boxes, "left_id")
    a = _strips(own.withColumnRenamed(key, "left_id"), step, "l_", "left_id")
    b = _strips(ring_signs(right, key).withColumnRenamed(key, "right_id"), step, "r_", "right_id")
    met = a.join(wanted, "left_id").join(b, ["right_id", "strip"])
    # a right side below the left polygon's box lies below as much of it from above as from below: nothing
    met = met.where(F.greatest("r_ya", "r_yb") > F.col("_y0"))
    low, high = F.greatest("l_a", "r_a"), F.least("l_b", "r_b")
    met = met.withColumns({"_lo": low, "_hi": high}).where("_lo < _hi")

    def at(prefix: str, x: str) -> Column:
        share = (F.col(x) - F.col(f"{prefix}a")) / (F.col(f"{prefix}b") - F.col(f"{prefix}a"))
        return F.col(f"{prefix}ya") + share * (F.col(f"{prefix}yb") - F.col(f"{prefix}ya")) - F.col("_y0")

    met = met.withColumns({"_l1": at("l_", "_lo"), "_l2": at("l_", "_hi"), "_r1": at("r_", "_lo"), "_r2": at("r_", "_hi")})
    d1, d2 = F.col("_l1") - F.col("_r1"), F.col("_l2") - F.col("_r2")
    total = F.abs(d1) + F.abs(d2)
    # the mean distance of the two lines, which may cross once
    apart = F.when(d1 * d2 >= 0, total / 2).otherwise((d1 * d1 + d2 * d2) / (2 * total))
    lower = (F.col("_l1") + F.col("_l2") + F.col("_r1") + F.col("_r2")) / 4 - apart / 2
    summed = met.groupBy("left_id", "right_id").agg(
        F.sum(F.col("l_s") * F.col("r_s") * (F.col("_hi") - F.col("_lo")) * lower).alias("area"),
        F.first((F.col("xmax") - F.col("_x0")) * (F.col("ymax") - F.col("_y0"))).alias("_box"),
    )
    # what rounding leaves of polygons that share no area
    real = summed.where(F.col("area") > F.col("_box") * 1e-12)
    return real.join(size, "left_id").select("left_id", "right_id", "area", (F.col("area") / F.col("own")).alias("share"))


def assign_largest_overlap(
    candidates: DataFrame,
    regions: DataFrame,
    region_order: DataFrame,
    step: float,
    cell_size: float,
    key: str = "polygon_id",
) -> DataFrame:
    """Region sharing most area with each candidate, and its share of the candidate; null and 0 where none does.

    Equal areas (to nine decimals of the candidate's) go to the region listed first in
    ``region_order`` (key, pos).  ``step``: see ``overlap_areas``.
    """
    shared = overlap_areas(candidates, regions, polygons_meeting(candidates, regions, cell_size, key), step, key)
    ranked = shared.join(region_order.select(F.col(key).alias("right_id"), "pos"), "right_id")
    best = ranked.groupBy(F.col("left_id").alias("candidate_id")).agg(
        F.max_by(F.struct("right_id", "share"), F.struct(F.round("share", 9), -F.col("pos"))).alias("b")
    )
    ids = candidates.select(F.col(key).alias("candidate_id")).distinct()
    return ids.join(best, "candidate_id", "left").select(
        "candidate_id", F.col("b.right_id").alias("region_id"), F.coalesce("b.share", F.lit(0.0)).alias("shared_share")
    )


# --- union of polygons ----------------------------------------------------------


def split_sides(sides: DataFrame, group: str, side: str, cell_size: float) -> DataFrame:
    """Sides cut wherever another side of their group touches or crosses them: consecutive pieces, in the side's direction.

    ``sides``: group, side (an id), x1, y1, x2, y2.  Two sides are compared in one cell
    only, the first that both are listed under; a crossing is computed once for both.
    """
    xs = cell_range(F.least("x1", "x2"), F.greatest("x1", "x2"), cell_size)
    ys = cell_range(F.least("y1", "y2"), F.greatest("y1", "y2"), cell_size)
    listed = sides.select(group, side, *EDGE_STRUCT, xs.alias("_xs"), ys.alias("_ys"))
    listed = listed.withColumn("xcell", F.explode("_xs")).withColumn("ycell", F.explode("_ys"))
    first = {"_fx": F.col("_xs")[0], "_fy": F.col("_ys")[0]}
    listed = listed.withColumns(first).drop("_xs", "_ys")
    a = listed.select(group, "xcell", "ycell", *[F.col(c).alias(f"a_{c}") for c in (side, *EDGE_STRUCT, "_fx", "_fy")])
    b = listed.select(group, "xcell", "ycell", *[F.col(c).alias(f"b_{c}") for c in (side, *EDGE_STRUCT, "_fx", "_fy")])
    ax1, ay1, ax2, ay2 = (F.col(f"a_{c}") for c in EDGE_STRUCT)
    bx1, by1, bx2, by2 = (F.col(f"b_{c}") for c in EDGE_STRUCT)
    met = a.join(b, [group, "xcell", "ycell"]).where(F.col(f"a_{side}") < F.col(f"b_{side}"))
    met = met.where((F.col("xcell") == F.greatest("a__fx", "b__fx")) & (F.col("ycell") == F.greatest("a__fy", "b__fy")))
    met = met.where(segments_touch((ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2)))
    o1, o2 = _orientation(ax1, ay1, ax2, ay2, bx1, by1), _orientation(ax1, ay1, ax2, ay2, bx2, by2)
    o3, o4 = _orientation(bx1, by1, bx2, by2, ax1, ay1), _orientation(bx1, by1, bx2, by2, ax2, ay2)
    t = F.try_divide((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1), (ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1))

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    def within(x: Column, y: Column, p: Sequence[Column]) -> Column:
        return x.between(F.least(p[0], p[2]), F.greatest(p[0], p[2])) & y.between(F.least(p[1], p[3]), F.greatest(p[1], p[3]))

    box_a, box_b = (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2)
    crossing = F.when((o1 * o2 < 0) & (o3 * o4 < 0), point(ax1 + t * (ax2 - ax1), ay1 + t * (ay2 - ay1)))
    ends_on_a = [F.when((o1 == 0) & within(bx1, by1, box_a), point(bx1, by1)), F.when((o2 == 0) & within(bx2, by2, box_a), point(bx2, by2))]
    ends_on_b = [F.when((o3 == 0) & within(ax1, ay1, box_b), point(ax1, ay1)), F.when((o4 == 0) & within(ax2, ay2, box_b), point(ax2, ay2))]
    on_a = met.select(group, F.col(f"a_{side}").alias(side), F.explode(F.array_compact(F.array(crossing, *ends_on_a))).alias("p"))
    on_b = met.select(group, F.col(f"b_{side}").alias(side), F.explode(F.array_compact(F.array(crossing, *ends_on_b))).alias("p"))
    ends = sides.select(group, side, F.explode(F.array(point(F.col("x1"), F.col("y1")), point(F.col("x2"), F.col("y2")))).alias("p"))
    points = on_a.unionByName(on_b).unionByName(ends).distinct().join(sides.select(group, side, *EDGE_STRUCT), [group, side])
    along = (F.col("p.x") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("p.y") - F.col("y1")) * (F.col("y2") - F.col("y1"))
    ordered = points.withColumn("_q", F.lead("p").over(W.partitionBy(group, side).orderBy(along, "p")))
    return ordered.where("_q is not null").select(group, side, "p", F.col("_q").alias("q"))


def dissolve_outline(edges: DataFrame, groups: DataFrame, key: str = "polygon_id", cell_size: float = 1 / 64) -> DataFrame:
    """Sides of the union of each group's polygons, cut where sides met.

    ``groups``: group_id, key.  Polygons may overlap, lie within one another, or meet in
    parts of sides; what is covered on both sides is not part of the outline.
    """
    signed = ring_signs(edges, key).join(groups.select("group_id", key), key).where("x1 <> x2 or y1 <> y2")
    sides = signed.withColumn("_side", F.struct(key, "_part", "_ring", *EDGE_STRUCT))
    pieces = split_sides(sides.select("group_id", "_side", *EDGE_STRUCT).distinct(), "group_id", "_side", cell_size)
    pieces = pieces.join(sides.select("group_id", "_side", F.col(key).alias("_owner"), "_sign").distinct(), ["group_id", "_side"])
    forward = F.col("p") < F.col("q")
    left = (F.col("_sign") > 0) == forward
    turned = pieces.select(
        "group_id", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "_owner", left.alias("_left")
    )
    sided = turned.groupBy("group_id", "p", "q").agg(F.bool_or("_left").alias("_l"), F.bool_or(~F.col("_left")).alias("_r")).where("_l <> _r")
    # another member may cover both sides of a piece
    middle = sided.select("group_id", "p", "q", ((F.col("p.x") + F.col("q.x")) / 2).alias("lon"), ((F.col("p.y") + F.col("q.y")) / 2).alias("lat"))
    inside = points_in_polygons(middle, edges, cell_size, key).join(groups.select("group_id", key), ["group_id", key], "left_semi")
    owners = turned.select("group_id", "p", "q", F.col("_owner").alias(key))
    covered = inside.join(owners, ["group_id", "p", "q", key], "left_anti").select("group_id", "p", "q").distinct()
    outline = sided.join(covered, ["group_id", "p", "q"], "left_anti")
    return outline.select(
        "group_id", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2")
    )


# --- distance zones -----------------------------------------------------------


def near_pairs(
    places: DataFrame, pixels: DataFrame, radius_m: float, place_key: str, pixel_key: str
) -> DataFrame:
    """(place, pixel, dist_m) within ``radius_m``; both sides need lon and lat.

    Grid cells are as high as the radius; in longitude a place is listed under as many
    cells as the radius spans at its latitude, and again a full turn away where that
    crosses 180 degrees, so the join is exact up to the poles' caps.
    """
    step = radius_m / C.M_PER_DEG_LAT * 1.01
    margin_lon = F.least(F.lit(360.0), F.lit(step) / F.greatest(F.cos(F.radians(F.abs("lat") + step)), F.lit(1e-6)))
    west, east = F.col("lon") - margin_lon, F.col("lon") + margin_lon
    none = F.array().cast("array<bigint>")
    xs = F.concat(
        cell_range(west, east, step),
        F.when(west < -180, cell_range(west + 360, east + 360, step)).otherwise(none),
        F.when(east > 180, cell_range(west - 360, east - 360, step)).otherwise(none),
    )
    ys = cell_range(F.col("lat") - step, F.col("lat") + step, step)
    spread = places.select(
        place_key,
        F.col("lon").alias("_plon"),
        F.col("lat").alias("_plat"),
        F.explode(F.array_distinct(xs)).alias("xcell"),
        ys.alias("_ys"),
    ).withColumn("ycell", F.explode("_ys")).drop("_ys")
    located = pixels.select(pixel_key, "lon", "lat", cell("lon", step).alias("xcell"), cell("lat", step).alias("ycell"))
    pairs = sized_join(located, spread, ["xcell", "ycell"])
    dist = haversine_m(F.col("_plat"), F.col("_plon"), F.col("lat"), F.col("lon"))
    return pairs.select(place_key, pixel_key, dist.alias("dist_m")).where(F.col("dist_m") <= radius_m)


def distinct_places(assets: DataFrame, asset_key: str) -> tuple[DataFrame, DataFrame]:
    """(places: place_id, lon, lat; members: place_id, asset) - assets on one spot share zones."""
    members = assets.select(F.struct("lon", "lat").alias("place_id"), asset_key)
    places = members.select("place_id").distinct().select("place_id", "place_id.lon", "place_id.lat")
    return places, members


def build_zones(
    places: DataFrame,
    pixels: DataFrame,
    place_key: str = "place_id",
    pixel_key: str = "pixel_id",
    treated_m: float = C.TREATED_RADIUS_M,
    inner_m: float = C.CONTROL_INNER_M,
    outer_m: float = C.CONTROL_OUTER_M,
) -> DataFrame:
    """(place, pixel, zone): treated disc, and control ring minus every other place's disc.

    A ring pixel is never in its own place's disc, so "inside any disc" already means
    "inside another place's disc": one pixel list, not a test per pair of places.
    """
    pairs = near_pairs(places, pixels, outer_m, place_key, pixel_key)
    nearest = F.min("dist_m").over(W.partitionBy(pixel_key))  # a pixel meets the places within the outer radius
    zone = F.when(F.col("dist_m") <= treated_m, "treated").when(
        (F.col("dist_m") >= inner_m) & (F.col("_nearest") > treated_m), "control"
    )
    kept = pairs.withColumn("_nearest", nearest).withColumn("zone", zone).where("zone is not null")
    return kept.select(place_key, pixel_key, "zone")
