"""Skew-proof and indexed forms against plain brute force, including hot keys."""

import hashlib
import math
import random
import zlib

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basinlens.operators import common, hash_groups, impact, photos, raster, spatial

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def brute_least(rows, k=6, every=False):
    out = {}
    for rid, h in rows:
        for other, g in rows:
            if h is None or g is None or not (other < rid or every and other > rid):
                continue
            d = bin((h ^ g) & ((1 << 64) - 1)).count("1")
            if d <= k:
                out[rid] = min(out.get(rid, 99), d)
    return out


@FEW
@given(st.integers(0, 2**32), st.sampled_from([7, 8, 9, 11]), st.booleans())
def test_duplicates_equal_brute_force(spark, seed, blocks, every):
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    rows = []
    for rid in range(60):
        h = rng.choice(bases)
        for bit in rng.sample(range(64), rng.randrange(9)):
            h ^= 1 << bit
        rows.append((rid, signed(h)))
        if rid % 4 == 0:
            rows.append((rid, signed(h ^ 1)))  # a record's own photos are not compared
    rows += [(100 + i, signed(bases[0])) for i in range(60)] + [(200, None)]  # a hot hash, a missing one
    df = spark.createDataFrame(rows, "record_id long, phash long")
    out = photos.duplicate_distance(df, "all" if every else "before", blocks=blocks)
    assert {r["record_id"]: r["min_distance"] for r in out.collect()} == brute_least(rows, every=every)


def test_duplicates_with_stored_history(spark):
    old = spark.createDataFrame([(1, 0b111), (2, 1 << 40)], "record_id long, phash long")
    new = spark.createDataFrame([(10, 0b111 ^ (0b111111 << 20)), (11, 1 << 40), (12, 0b1111111 << 50)], "record_id long, phash long")
    out = photos.duplicate_distance(new, stored=photos.stored_hashes(old), blocks=8)
    got = {r["record_id"]: r["min_distance"] for r in out.collect()}
    # 10 is 6 bits from record 1 but nearer to record 2 or 1 by no less; 11 repeats record 2; 12 is 7 or more bits away
    assert got == {10: 6, 11: 0}


def test_block_masks_cover_every_pattern():
    for m in (7, 8, 9):
        masks = [x & (1 << 64) - 1 for x in photos.block_masks(m)]
        rng = random.Random(m)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 6))
            assert any(flips & mask == 0 for mask in masks)
    assert photos.choose_blocks(10**9) > photos.choose_blocks(10**4)


def test_split_hot_join_keeps_every_row(spark):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    right = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = common.split_hot_join(left, right, "k", spread="id", hot_share=0.01, pieces=8)
    assert out.count() == 3000 and out.where("v <> k * 2").count() == 0
    assert out.where("k = 7").count() == 1000 + 1


def test_global_row_number(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 101).alias("s"), F.col("id").alias("pos"))
    out = common.global_row_number(df, [F.desc("s"), F.asc("pos")], "rank").collect()
    want = sorted(((r["s"], r["pos"]) for r in out), key=lambda x: (-x[0], x[1]))
    assert [(r["s"], r["pos"]) for r in sorted(out, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in out) == list(range(1, 1001))


def test_forward_fill_in_chunks_equals_one_window(spark):
    df = spark.range(500).select(
        (F.col("id") % 3).alias("p"), F.col("id").alias("t"), F.when(F.col("id") % 11 == 0, F.col("id")).alias("v")
    )
    plain = common.forward_fill(df, "v", "t", ["p"], name="f")
    cut = common.forward_fill(df, "v", "t", ["p"], chunk=F.floor(F.col("t") / 50), name="f")
    assert set(map(tuple, plain.collect())) == set(map(tuple, cut.collect()))


def edges_of(spark, polygons):
    rows = []
    for name, rings in polygons.items():
        for r, ring in enumerate(rings):
            for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1])):
                rows.append((name, 0, r, i, *map(float, a), *map(float, b)))
    return spark.createDataFrame(rows, "polygon_id string, part int, ring int, edge int, x1 double, y1 double, x2 double, y2 double")


def inside_exact(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            cross = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
            if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and (cross > 0) == (y2 > y1):
                odd = not odd
    return odd


STAR = [(0, 0), (8, 1), (4, 3), (9, 9), (3, 5), (1, 8)]
HOLED = [[(20, 0), (28, 0), (28, 8), (20, 8)], [(22, 2), (22, 6), (26, 6), (26, 2)]]


@FEW
@given(st.integers(0, 5), st.sampled_from([0.5, 1.0, 3.0, 50.0]))
def test_point_in_polygon_any_start_vertex_and_cell(spark, turn, size):
    shapes = {"star": [STAR[turn:] + STAR[:turn]], "holed": HOLED}
    points = [(i, x / 2, y / 2) for i, (x, y) in enumerate((x, y) for x in range(-2, 60, 3) for y in range(-2, 20, 2))]
    points += [(1000, 20.0, 4.0), (1001, 24.0, 2.0), (1002, 0.0, 0.0), (1003, 24.0, 4.0), (1004, 21.0, 4.0)]
    df = spark.createDataFrame(points, "id long, lon double, lat double")
    out = spatial.points_in_polygons(df, edges_of(spark, shapes), size)
    got = {(r["id"], r["polygon_id"]) for r in out.collect()}
    assert got == {(i, n) for i, x, y in points for n, rings in shapes.items() if inside_exact(x, y, rings)}
    assert (1000, "holed") not in got and (1003, "holed") not in got and (1004, "holed") in got


def test_sized_join_paths_agree(spark):
    left, right = spark.range(100), spark.range(50).withColumn("v", F.lit(1))
    small = common.sized_join(left, right, ["id"], "left")
    big = common.sized_join(left, right, ["id"], "left", limit=10)
    plan = big._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and sorted(map(tuple, small.collect()), key=repr) == sorted(map(tuple, big.collect()), key=repr)


def test_polygon_relations(spark):
    def square(x, y, w):
        return [[(x, y), (x + w, y), (x + w, y + w), (x, y + w)]]

    shapes = {"a": square(0, 0, 10), "in": square(4, 4, 1), "near": square(10.5, 0, 2), "far": square(30, 30, 1), "touch": square(10, 8, 1)}
    e = edges_of(spark, shapes)
    pairs = {(r["left_id"], r["right_id"]) for r in spatial.neighbours(e, 0.5, 2.0).collect()}
    want = {("a", "in"), ("a", "near"), ("a", "touch")}
    assert pairs == want | {(b, a) for a, b in want}
    meeting = {(r["left_id"], r["right_id"]) for r in spatial.polygons_meeting(e, e, 2.0).where("left_id < right_id").collect()}
    assert meeting == {("a", "in"), ("a", "touch")}


def test_area_counts_holes(spark):
    areas = {r["polygon_id"]: r["area_ha"] for r in spatial.polygon_area_ha(edges_of(spark, {"h": HOLED, "full": HOLED[:1]})).collect()}
    assert abs(areas["h"] / areas["full"] - 48 / 64) < 1e-9


def test_slope_on_a_3x3_grid(spark):
    import math

    heights = {(r, c): 10.0 * c + 5.0 * r for r in range(3) for c in range(3)}
    heights[(2, 2)] = -9999.0
    df = spark.createDataFrame([(r, c, z) for (r, c), z in heights.items()], "r long, c long, z double")
    step = 1 / 110_574
    out = {(r["r"], r["c"]): r["slope_deg"] for r in raster.slope_degrees(df, 1 / 111_320, step, 0.0).collect()}
    plane = math.degrees(math.atan(math.hypot(10, 5)))
    for at in [(0, 0), (0, 1), (1, 0), (0, 2), (1, 1), (2, 0)]:
        expected = plane
        assert out[at] is not None and abs(out[at] - expected) < 1e-9, at
    assert out[(2, 2)] is None and out[(1, 2)] is None and out[(2, 1)] is None


def long_series(spark, units):
    rows = [(u, y, v) for u, values in units.items() for y, v in values.items()]
    return spark.createDataFrame(rows, "unit_id string, year int, value double")


def test_bootstrap_properties(spark):
    treated = spark.createDataFrame([(y, 0.30 + 0.1 * (y >= 2021)) for y in range(2019, 2023)], "year int, value double")
    same = long_series(spark, {f"c{i}": {y: 0.30 for y in range(2019, 2023)} for i in range(5)})
    row = impact.bootstrap_did(treated, same, 2021, draws=50).first()
    assert abs(row["effect"] - 0.1) < 1e-12 and abs(row["ci_high"] - row["ci_low"]) < 1e-12
    widths = []
    for spread in (0.05, 0.15):
        units = {f"c{i}": {y: 0.30 + (spread * d if y >= 2021 else 0) for y in range(2019, 2023)} for i, d in enumerate((-1, 0, 1, 0.5))}
        r = impact.bootstrap_did(treated, long_series(spark, units), 2021, draws=200).first()
        widths.append(r["ci_high"] - r["ci_low"])
    assert 0 < widths[0] < widths[1]
    again = impact.bootstrap_did(treated, long_series(spark, units), 2021, draws=200).first()
    assert (again["ci_low"], again["ci_high"]) == (r["ci_low"], r["ci_high"])
    shifted = {u: {y: v + 7.0 * (u == "c1") for y, v in s.items()} for u, s in units.items()}
    assert abs(impact.bootstrap_did(treated, long_series(spark, shifted), 2021, draws=20).first()["effect"] - r["effect"]) < 1e-9


def test_bootstrap_equals_brute_force_per_group(spark):
    """Groups with different controls, and several rows of one unit and year, which count as their mean."""
    treated = [("N", y, 0.1 * y) for y in range(5)] + [("M", 1, 2.0), ("M", 4, 5.0)]
    rows = [(i, f"c{u}", y, float((u * 7 + y * 3) % 11)) for i, n in (("N", 9), ("M", 3)) for u in range(n) for y in range(5) if (u + y) % 4]
    rows += [("M", "c1", 1, 40.0), ("N", "c2", 0, -3.0), ("N", "c2", 0, -3.0)]
    out = impact.bootstrap_effects(
        spark.createDataFrame(treated, "idx string, year int, value double"),
        spark.createDataFrame(rows, "idx string, unit_id string, year int, value double"), 3, draws=40, by=["idx"],
    )
    got = {(r["idx"], r["b"]): r["effect"] for r in out.collect()}
    want = {}
    for idx in ("N", "M"):
        units = sorted({r[1] for r in rows if r[0] == idx})
        own = {y: v for i, y, v in treated if i == idx}
        for b in range(40):
            drawn = [units[int(hashlib.md5(f"42-{b}-{i}".encode()).hexdigest()[:8], 16) % len(units)] for i in range(len(units))]
            gap = {}
            for y in own:
                values = [[r[3] for r in rows if r[:3] == (idx, u, y)] for u in drawn]
                means = [sum(v) / len(v) for v in values if v]
                if means:
                    gap[y] = own[y] - sum(means) / len(means)
            pre, post = [v for y, v in gap.items() if y < 3], [v for y, v in gap.items() if y >= 3]
            if pre and post:
                want[idx, b] = sum(post) / len(post) - sum(pre) / len(pre)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_missing_controls_and_years_give_notes(spark):
    treated = spark.createDataFrame([(2019, 0.1), (2020, 0.2)], "year int, value double")
    none = long_series(spark, {"c": {2019: 0.1}}).where("false")
    row = impact.bootstrap_did(treated, none, 2020, draws=5).first()
    assert row["effect"] is None and row["note"].startswith("No control polygons")
    row = impact.bootstrap_did(treated, long_series(spark, {"c": {2019: 0.1}}), 2020, draws=5).first()
    assert row["effect"] is None and row["ci_low"] is None and row["pre_years"] == [2019]


def test_overlapping_windows_share_observations(spark):
    rows = [(1, f"2000-01-{d:02d}", 0, 9000 + d, 9000, 12000, 9500) for d in range(1, 11)]
    obs = spark.createDataFrame(rows, "pixel_id long, day string, qa int, b3 int, b4 int, b5 int, b6 int").withColumn("ts", F.to_timestamp("day"))
    out = raster.windowed_composites(obs, {"x": ("2000-01-01", "2000-01-06"), "y": ("2000-01-03", "2000-01-10")})
    assert {r["window"]: r["clear_obs"] for r in out.collect()} == {"x": 5, "y": 7}


def test_hot_pixels_have_the_same_medians(spark):
    k = F.col("id")
    clear = spark.range(4000).select(
        F.when(k % 3 == 0, 0).otherwise(k % 40).alias("pixel_id"),
        ((k * 7919 % 2003) / 1000 - 1).alias("ndvi"),
        F.when(k % 5 != 0, (k * 104729 % 53) / 53).alias("mndwi"),
        (-(k * 31 % 17) / 17).alias("ndmi"),
    )
    plain = {r["pixel_id"]: r for r in raster.median_composite(clear).collect()}
    split = {r["pixel_id"]: r for r in raster.median_composite(clear, hot_rows=300, sample=1.0).collect()}
    assert plain.keys() == split.keys()
    for pixel, a in plain.items():
        b = split[pixel]
        assert a["clear_obs"] == b["clear_obs"]
        assert all(a[i] == b[i] or abs(a[i] - b[i]) < 1e-12 for i in raster.INDICES)
    assert plain[5]["mndwi"] is None and plain[0]["clear_obs"] > 1300
    coarse = {r["pixel_id"]: r["ndvi"] for r in raster.hot_medians(clear, ["pixel_id"], steps=4).collect()}
    assert all(abs(coarse[p] - a["ndvi"]) < 1e-12 for p, a in plain.items())


def square(key, x, y, w):
    corners = [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    return [(key, 0, 0, i, *a, *b) for i, (a, b) in enumerate(zip(corners, corners[1:]))]


EDGE_SCHEMA = "polygon_id string, part int, ring int, edge int, x1 double, y1 double, x2 double, y2 double"


def test_small_polygons_find_their_region(spark):
    """Candidates far smaller than the grid step, one between cell centres and one across two regions."""
    candidates = spark.createDataFrame(square("tiny", 0.011, 0.012, 0.001) + square("both", 0.996, 0.3, 0.01), EDGE_SCHEMA)
    regions = spark.createDataFrame(square("A", 0.0, 0.0, 1.0) + square("B", 1.0, 0.0, 1.0), EDGE_SCHEMA)
    order = spark.createDataFrame([("A", 1), ("B", 2)], "polygon_id string, pos int")
    got = {r["candidate_id"]: r["region_id"] for r in spatial.assign_largest_overlap(candidates, regions, order, 0.1, 0.25).collect()}
    assert got == {"tiny": "A", "both": "B"}


def test_zones_across_180_degrees(spark):
    places = spark.createDataFrame([("p", 179.9999, 10.0), ("q", -179.9999, 60.0)], "place_id string, lon double, lat double")
    pixels = spark.createDataFrame([(1, -179.9999, 10.0), (2, 179.9999, 60.0), (3, 0.0, 10.0)], "pixel_id int, lon double, lat double")
    got = {(r["place_id"], r["pixel_id"]) for r in spatial.near_pairs(places, pixels, 50.0, "place_id", "pixel_id").collect()}
    assert got == {("p", 1), ("q", 2)}
    assert {(r["place_id"], r["zone"]) for r in spatial.build_zones(places, pixels).collect()} == {("p", "treated"), ("q", "treated")}


def test_slopes_do_not_depend_on_squares(spark):
    """Holes, no-data heights, negative places and several grids: small squares give what one square gives, and what a plain loop gives."""
    pick = random.Random(4)
    rows = [(g, r, c, None if pick.random() < 0.1 else -9999.0 if pick.random() < 0.1 else pick.uniform(0, 50), f"{g}{r}{c}") for g in ("a", "b") for r in range(-4, 7) for c in range(-3, 9) if pick.random() < 0.8]
    dem = spark.createDataFrame(rows, "grid string, r long, c int, z double, name string")
    height = {(g, r, c): None if z is None or z < -1000 else z for g, r, c, z, _ in rows}
    dx, dy = 111_320.0 * math.cos(math.radians(26.0)) / 100, 110_574.0 / 50

    def gradient(g, r, c, by, size):
        before, own, after = (height.get((g, r + by[0] * s, c + by[1] * s), "none") for s in (-1, 0, 1))
        pair = (after, before, 2) if "none" not in (before, after) else (after, own, 1) if after != "none" else (own, before, 1) if before != "none" else (None, None, 1)
        return None if None in pair[:2] else (pair[0] - pair[1]) / (pair[2] * size)

    want = {}
    for g, r, c, _, _ in rows:
        sides = gradient(g, r, c, (0, 1), dx), gradient(g, r, c, (1, 0), dy)
        want[g, r, c] = None if None in sides else math.degrees(math.atan(math.hypot(*sides)))
    for side in (2, 5, 256):
        out = raster.slope_degrees(dem, 1 / 100, 1 / 50, 26.0, ["grid"], side).collect()
        assert len(out) == len(rows) and all(r["name"] == f"{r['grid']}{r['r']}{r['c']}" for r in out)
        assert {(r["grid"], r["r"], r["c"]): r["slope_deg"] and round(r["slope_deg"], 9) for r in out} == {k: v and round(v, 9) for k, v in want.items()}


@pytest.mark.parametrize("large", [2_000_000, 30])
def test_a_hash_is_shuffled_once_per_lead_and_not_per_key(spark, monkeypatch, large):
    """84 keys a hash filled the disks; groups beyond the bound (here: most) still lose no pair."""
    monkeypatch.setattr(photos, "GROUP_ROWS", large)
    rng = random.Random(large)
    near = [rng.getrandbits(64) for _ in range(60)]
    rows = [(i, rng.choice(near) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(8)))) for i in range(700)]
    hot = rng.getrandbits(64)
    rows += [(700 + i, hot & ~0xFFFFF | rng.getrandbits(20)) for i in range(150)]  # 44 bits in common
    df = spark.createDataFrame([(i, signed(h)) for i, h in rows], "record_id long, phash long")
    for every in (False, True):
        out = photos.duplicate_distance(df, "all" if every else "before", blocks=9)
        assert {r["record_id"]: r["min_distance"] for r in out.collect()} == brute_least(rows, every=every)
    if large > len(rows):
        assert "array(" in (plan := out._jdf.queryExecution().analyzed().toString())
        assert max(line.count("& ") for line in plan.splitlines() if "explode(" in line) <= 7


def test_a_pair_has_one_choice_of_first_blocks():
    rng = random.Random(5)
    for blocks, depth in ((7, 1), (9, 1), (9, 2), (9, 3), (11, 2)):
        choices = photos.leading_choices(blocks, depth)
        for _ in range(200):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(7)))
            met = [1 for lead, rest in choices for mask, differ in rest if not flips & (lead | mask) and all(flips & b for b in differ)]
            assert len(met) == 1


def test_hashes_travel_packed(spark):
    """A listed row of its own took 31 bytes of a shuffle, seven times a hash; packed ones take a third of that."""
    rng = random.Random(3)
    rows = [(rng.getrandbits(64), 10**9 + i, i % 3 > 0, i % 3 < 2) for i in range(30_000)]
    last = [i + 5 if n % 50 == 0 else i for n, (_, i, _, _) in enumerate(rows)]
    hashes = [signed(h) for h, *_ in rows]
    firsts = [i if stored else None for _, i, _, stored in rows]
    table = pa.table({"phash": hashes, "asks": [a for *_, a, _ in rows], "stored": [s for *_, s in rows], "first_id": pa.array(firsts, pa.int64()), "last_id": pa.array([i if f else None for i, f in zip(last, firsts)], pa.int64())})
    masks, ids = [lead for lead, _ in photos.leading_choices(9, 1)], ["first_id", "last_id"]
    left_out = frozenset({(2, signed(rows[0][0] & masks[2]))})
    groups = {}
    for batch in hash_groups.pack_groups(iter(table.to_batches(max_chunksize=7_000)), masks, ids, left_out):
        for r in batch.to_pylist():
            groups.setdefault((r["_choice"], r["_lead"]), []).append(r)
    got = set()
    for (choice, lead), packed in groups.items():
        out = hash_groups.unpacked(pa.Table.from_pylist(packed), ids).to_pylist()
        assert {signed(r["phash"] & masks[choice]) for r in out} == {lead}
        got |= {(choice, *(r[c] if r["stored"] or "id" not in c else None for c in table.column_names)) for r in out}
    want = {(c, *row) for row in zip(*table.to_pydict().values(), strict=True) for c, m in enumerate(masks)}
    assert got == {row for row in want if (row[0], signed(row[1] & masks[row[0]])) not in left_out}
    sent = b"".join(r["packed"] for packed in groups.values() for r in packed)
    assert len(zlib.compress(sent, 1)) < 13 * sum(r["rows"] for packed in groups.values() for r in packed)
    found = photos.duplicate_distance(spark.createDataFrame([(1, 5), (2, 4)], "record_id long, phash long"))
    assert "packed" in found._jdf.queryExecution().analyzed().toString() and [tuple(r) for r in found.collect()] == [(2, 1)]
