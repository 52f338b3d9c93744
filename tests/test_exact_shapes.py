"""Overlap areas and union outlines against exact cross-sections."""

import random
from fractions import Fraction as Q

import pytest

from basinlens.operators import spatial

EDGES = "polygon_id string, part int, ring int, edge int, x1 double, y1 double, x2 double, y2 double"


def sides(rings):
    """[(x1, y1, x2, y2)] of closed rings of points."""
    return [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]


def edge_table(spark, shapes):
    """Shapes: {id: [rings of one part]}; rings after the first are holes."""
    rows = [(i, 0, r, n, *map(float, s)) for i, rings in shapes.items() for r, ring in enumerate(rings) for n, s in enumerate(sides([ring]))]
    return spark.createDataFrame(rows, EDGES)


def events(segments):
    """All x at which two segments meet or one ends."""
    out = {x for x1, _, x2, _ in segments for x in (x1, x2)}
    for i, (ax1, ay1, ax2, ay2) in enumerate(segments):
        for bx1, by1, bx2, by2 in segments[i + 1 :]:
            d = (ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1)
            if d:
                t = Q((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1), d)
                if 0 <= t <= 1:
                    out.add(ax1 + t * (ax2 - ax1))
    return sorted(out)


def heights(segments, x):
    """Ascending y of the segments that cross x (x is no end of any)."""
    return sorted(y1 + Q(y2 - y1, x2 - x1) * (x - x1) for x1, y1, x2, y2 in segments if min(x1, x2) < x < max(x1, x2))


def spans(ys):
    return list(zip(ys[::2], ys[1::2], strict=True))


def shared(one, two):
    return sum(max(0, min(b, d) - max(a, c)) for a, b in one for c, d in two)


def exact_overlap(a, b):
    """Cross-sections change linearly between events, so the middle one gives the area of a slab."""
    sa, sb = ([tuple(map(Q, s)) for s in sides(rings)] for rings in (a, b))
    xs = events(sa + sb)
    return sum((hi - lo) * shared(spans(heights(sa, (lo + hi) / 2)), spans(heights(sb, (lo + hi) / 2))) for lo, hi in zip(xs, xs[1:], strict=False))


def star(pick, cx, cy, size, n=7):
    """A ring around a centre, usually concave."""
    from math import cos, pi, sin

    ring = [(cx + round(size * pick.uniform(0.3, 1) * cos(2 * pi * i / n), 3), cy + round(size * pick.uniform(0.3, 1) * sin(2 * pi * i / n), 3)) for i in range(n)]
    return ring if pick.random() < 0.5 else ring[::-1]


def overlaps(spark, left, right, step=0.25):
    a, b = edge_table(spark, left), edge_table(spark, right)
    pairs = spark.createDataFrame([(i, j) for i in left for j in right], "left_id string, right_id string")
    return {(r["left_id"], r["right_id"]): (r["area"], r["share"]) for r in spatial.overlap_areas(a, b, pairs, step).collect()}


def test_areas_of_concave_rings_and_holes_are_exact(spark):
    pick = random.Random(5)
    hole = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)]]
    left = {f"l{i}": [star(pick, pick.uniform(0, 4), pick.uniform(0, 4), 1.5)] for i in range(6)} | {"hole": hole, "in hole": [[(1.5, 1.5), (2.5, 1.5), (2, 2.5)]]}
    right = {f"r{i}": [star(pick, pick.uniform(0, 4), pick.uniform(0, 4), 2)] for i in range(6)} | {"hole": hole, "far": [[(9, 9), (9, 10), (10, 9)]]}
    for step in (0.25, 3.0):
        got = overlaps(spark, left, right, step)
        for (i, a), (j, b) in [(x, y) for x in left.items() for y in right.items()]:
            want, own = float(exact_overlap(a, b)), float(exact_overlap(a, a))
            area, share = got.get((i, j), (0.0, 0.0))
            assert area == pytest.approx(want, abs=1e-9) and share == pytest.approx(want / own, abs=1e-9), (i, j)
            assert ((i, j) in got) == (want > 0)


def test_slivers_find_their_region(spark):
    left = {
        "diagonal": [[(0.003, 0.0), (1.003, 1.0), (1.00301, 1.0), (0.00301, 0.0)]],
        "border": [[(1.9, 0.2), (2.2, 0.2), (2.2, 0.4), (1.9, 0.4)]],
        "equal": [[(1.5, 1.0), (2.5, 1.0), (2.5, 1.5), (1.5, 1.5)]],
        "touching": [[(4.0, 0.0), (5.0, 0.0), (5.0, 1.0), (4.0, 1.0)]],
        "outside": [[(7.0, 7.0), (8.0, 7.0), (8.0, 8.0)]],
    }
    regions = {"west": [[(-1, -1), (2, -1), (2, 3), (-1, 3)]], "east": [[(2, -1), (4, -1), (4, 3), (2, 3)]]}
    order = spark.createDataFrame([("east", 0), ("west", 1)], "polygon_id string, pos int")
    out = spatial.assign_largest_overlap(edge_table(spark, left), edge_table(spark, regions), order, 0.5, 0.5)
    got = {r["candidate_id"]: (r["region_id"], r["shared_share"]) for r in out.collect()}
    assert got["diagonal"][0] == "west" and got["diagonal"][1] == pytest.approx(1.0, abs=1e-6)
    assert got["border"] == ("east", pytest.approx(2 / 3))
    assert got["equal"] == ("east", pytest.approx(0.5))  # listed first
    assert got["touching"] == (None, 0.0) and got["outside"] == (None, 0.0)


def outline_of(spark, members, groups=None, cell=0.5):
    rows = groups or [("g", i) for i in members]
    found = spatial.dissolve_outline(edge_table(spark, members), spark.createDataFrame(rows, "group_id string, polygon_id string"), cell_size=cell)
    out = {}
    for r in found.collect():
        out.setdefault(r["group_id"], []).append((r["x1"], r["y1"], r["x2"], r["y2"]))
    return out


def check_union(members, outline):
    """At every slab's middle the outline's heights are the ends of the members' merged spans."""
    exact = {i: [tuple(map(Q, s)) for s in sides(rings)] for i, rings in members.items()}
    xs = events([s for some in exact.values() for s in some])
    for lo, hi in zip(xs, xs[1:], strict=False):
        if hi - lo < Q(1, 10**6):
            continue
        x = (lo + hi) / 2
        merged: list[list] = []
        for a, b in sorted(span for some in exact.values() for span in spans(heights(some, x))):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        want = [float(y) for span in merged for y in span]
        got = [float(y) for y in heights([tuple(map(Q, s)) for s in outline], x)]
        assert got == pytest.approx(want, abs=1e-9), float(x)


def square(x, y, w=1.0, h=1.0):
    return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]


def test_union_of_squares_that_meet_at_a_t(spark):
    members = {"a": square(0, 0), "b": square(1, 0), "c": square(0, 1, 2)}
    outline = outline_of(spark, members)["g"]
    check_union(members, outline)
    assert all(not (0 < (x1 + x2) / 2 < 2 and 0 < (y1 + y2) / 2 < 2) for x1, y1, x2, y2 in outline)
    assert sum(abs(x1 - x2) + abs(y1 - y2) for x1, y1, x2, y2 in outline) == 8


def test_union_of_overlapping_nested_and_holed_polygons(spark):
    ring = [[(0, 0), (6, 0), (6, 6), (0, 6)], [(1, 1), (5, 1), (5, 5), (1, 5)]]
    cases = {
        "crossing": {"a": square(0, 0, 3, 1), "b": square(1, -1, 1, 3)},
        "nested": {"a": square(0, 0, 4, 4), "b": square(1, 1), "c": square(0, 0, 4, 4)},
        "filled hole": {"ring": ring, "core": square(1, 1, 4, 4)},
        "half filled": {"ring": ring, "core": square(1, 1, 4, 2)},
        "turned": {"a": [square(0, 0, 2, 2)[0][::-1]], "b": square(1, 1, 2, 2)},
        "apart": {"a": square(0, 0), "b": square(3, 3)},
    }
    for members in cases.values():
        check_union(members, outline_of(spark, members)["g"])


def test_union_of_random_concave_rings(spark):
    pick = random.Random(12)
    members = {f"m{i}": [star(pick, pick.uniform(0, 3), pick.uniform(0, 3), 1.2)] for i in range(6)}
    groups = [("one", f"m{i}") for i in range(6)] + [("two", f"m{i}") for i in range(0, 6, 2)]
    out = outline_of(spark, members, groups)
    check_union(members, out["one"])
    check_union({i: members[i] for g, i in groups if g == "two"}, out["two"])


def test_a_side_is_listed_under_the_cells_that_it_passes(spark):
    pick = random.Random(3)
    rows = [("d", 0, 0, 0, 0.0, 0.0, 50.0, 50.0), ("v", 0, 0, 0, 2.0, 1.0, 2.0, 9.0), ("h", 0, 0, 0, 8.0, 2.5, 1.0, 2.5)]
    rows += [(f"r{i}", 0, 0, 0, *(round(pick.uniform(0, 9), 2) for _ in range(4))) for i in range(30)]
    for margin in (0.0, 0.7):
        listed = spatial._edges_in_cells(spark.createDataFrame(rows, EDGES), "polygon_id", "l_", 1.0, margin).collect()
        cells = {}
        for r in listed:
            cells.setdefault(r["l_id"], set()).add((r["xcell"], r["ycell"]))
        assert len(cells["d"]) <= 4 * (50 + 2) * (1 + 2 * margin)  # its box has 2,500
        for name, _, _, _, x1, y1, x2, y2 in rows:
            for step in range(101):
                x, y = x1 + (x2 - x1) * step / 100, y1 + (y2 - y1) * step / 100
                for dx, dy in ((0, 0), (margin, 0), (-margin, 0), (0, margin), (0, -margin), (margin * 0.7, margin * 0.7)):
                    assert (int((x + dx) // 1), int((y + dy) // 1)) in cells[name], (name, x, y)
