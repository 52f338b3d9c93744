"""Tables kept as segments: keys, ranges, crashes, and the hash index on top of them."""

import os
import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from basinlens.operators import hash_index, photos, records
from basinlens.sources import segments

SCHEMA = "id long, v int, t string"


def keyed(spark, folder, **options):
    return records.keyed_table(spark, f"{folder}/table", ["id"], ["v"], **options)


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def state(table):
    return {r["id"]: (r["v"], r["t"]) for r in table.read().collect()}


def test_newest_row_per_key_through_compactions(spark, folder):
    table, want = keyed(spark, folder, fan=3, range_rows=20), {}
    pick = random.Random(1)
    for batch in range(11):
        values = [(pick.randrange(90), pick.randrange(5), f"{batch}-{i}") for i in range(25)]
        assert table.append(rows(spark, *values), batch)
        best = {}
        for key, v, t in values:  # one version: the later append; within an append any fixed one
            best.setdefault(key, []).append((v, t))
        for key, offered in best.items():
            top = max(v for v, _ in offered)
            if key not in want or want[key][0] <= top:
                want[key] = (top, {t for v, t in offered if v == top})
    got = state(table)
    assert got.keys() == want.keys()
    assert all(v == want[k][0] and t in want[k][1] for k, (v, t) in got.items())
    tiers = [s["tier"] for s in table.state()["segments"]]
    assert all(tiers.count(t) < 3 for t in tiers) and max(tiers) == 2
    assert any(s["bits"] for s in table.state()["segments"])
    assert table.vacuum() > 5 and state(table) == got


def test_rows_of_one_key_and_version_are_resolved_alike(spark, folder):
    values = [(1, 1, "a"), (1, 1, "b"), (1, 1, None), (2, None, "x"), (2, 0, "y")]
    first, second = keyed(spark, f"{folder}/one"), keyed(spark, f"{folder}/two")
    first.append(rows(spark, *values))
    second.append(rows(spark, *reversed(values)).repartition(5))
    assert state(first) == state(second) and state(first)[2] == (0, "y")
    first.append(rows(spark, (1, 1, "later"), (2, -1, "older")))
    assert state(first)[1] == (1, "later") and state(first)[2] == (0, "y")


def test_a_batch_counts_once_and_old_states_stay(spark, folder):
    table = keyed(spark, folder)
    assert table.read() is None and table.append(rows(spark, (1, 1, "a")), 0)
    assert table.append(rows(spark, (1, 2, "b")), 1)
    assert not table.append(rows(spark, (1, 9, "again")), 1) and not table.append(rows(spark, (1, 9, "again")), 0)
    assert table.append(rows(spark).limit(0), 2) and not table.append(rows(spark, (5, 5, "x")), 2)
    assert state(table) == {1: (2, "b")}
    assert {r["t"] for r in table.read(before=1).collect()} == {"a"} and table.read(before=0) is None


def test_a_crash_before_the_commit_leaves_the_old_state(spark, folder, monkeypatch):
    table = keyed(spark, folder)
    table.append(rows(spark, (1, 1, "a")), 0)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(segments.SegmentTable, "_commit", crash)
        with pytest.raises(OSError, match="lost"):
            table.append(rows(spark, (1, 2, "b")), 1)
    assert state(table) == {1: (1, "a")}
    assert len(os.listdir(f"{folder}/table/segments")) == 2  # written, named by nobody
    assert table.append(rows(spark, (1, 2, "b")), 1) and state(table) == {1: (2, "b")}
    assert table.vacuum(keep=1) == 1


def test_a_second_writer_is_refused(spark, folder):
    table, other = keyed(spark, folder), keyed(spark, folder)
    table.append(rows(spark, (1, 1, "a")))
    seen = other.state()
    table.append(rows(spark, (1, 2, "b")))
    with pytest.raises(Exception, match="[Ee]xist"):
        other._commit(seen | {"version": seen["version"] + 1, "segments": []})
    assert state(table) == {1: (2, "b")}


def size_of(df):
    files = [r[0] for r in df.select(F.input_file_name()).distinct().collect()]
    return sum(os.path.getsize(unquote(f.removeprefix("file://"))) for f in files)


def test_a_probe_reads_its_ranges_and_an_append_its_rows(spark, folder):
    table = keyed(spark, folder, range_rows=500)
    table.append(spark.range(40_000).select("id", F.lit(1).alias("v"), F.md5(F.col("id").cast("string")).alias("t")))
    probe = spark.createDataFrame([(7,), (39_999,)], "id long")
    assert table.read(probe).where("id in (7, 39999)").count() == 2
    whole, part = size_of(table.scan()), size_of(table.scan(probe))
    assert part < whole / 20
    before = whole
    table.append(rows(spark, (7, 2, "new")))
    added = size_of(table.scan()) - before
    assert added < whole / 100
    assert table.read(probe).where("id = 7").first()["t"] == "new"


def test_index_equals_the_plain_search_over_any_batches(spark, folder):
    pick = random.Random(4)
    bases = [pick.getrandbits(63) for _ in range(40)]
    hashes = [(i, pick.choice(bases) ^ sum(1 << b for b in pick.sample(range(63), pick.randrange(9)))) for i in range(900)]
    pick.shuffle(hashes)
    index = hash_index.HashIndex(spark, f"{folder}/index", blocks=8, fan=3, range_rows=2000)
    got = {}
    for batch in range(5):
        some = spark.createDataFrame([(batch * 1000 + i, h) for i, (_, h) in enumerate(hashes[batch * 180 : batch * 180 + 180])], "record_id long, phash long")
        near = photos.duplicate_distance(some, index=index, before=batch)
        got.update((r["record_id"], r["min_distance"]) for r in near.collect())
        assert index.append(photos.stored_hashes(some), batch)
        assert not index.append(photos.stored_hashes(some), batch)
        # asked again, the batch does not see itself in the index
        again = photos.duplicate_distance(some, index=index, before=batch)
        assert all(got[r["record_id"]] == r["min_distance"] for r in again.collect())
    arrived = [(n // 180 * 1000 + n % 180, h) for n, (_, h) in enumerate(hashes)]
    want = {}
    for at, (i, h) in enumerate(arrived):
        nearest = min(((h ^ other).bit_count() for _, other in arrived[:at]), default=99)
        if nearest <= 6:
            want[i] = nearest
    assert got == want
    assert hash_index.HashIndex(spark, f"{folder}/index", blocks=11).blocks == 8  # an old index keeps its own


def test_a_batch_reads_what_its_hashes_need(spark, folder):
    index = hash_index.HashIndex(spark, f"{folder}/index", blocks=8, range_rows=2000)
    stored = spark.range(20_000).select(F.xxhash64("id").alias("phash"), F.col("id").alias("first_id"), F.col("id").alias("last_id"), F.lit(1).cast("long").alias("n"))
    index.append(stored, 0)
    few = stored.limit(2).select("phash")
    whole = size_of(index.table.scan())
    probe = photos.hash_keys(few, 8)
    part = size_of(index.table.scan(probe))
    assert part < whole / 3  # 56 keys in 512 ranges
    found = index.entries(few).join(few, "phash").select("phash").distinct()
    assert found.count() == 2


def test_an_index_of_few_large_batches_keeps_one_row_per_hash(spark, folder):
    """Listed under 28 or 84 keys each, the hashes of two large batches were written dozens of times."""
    pick = random.Random(6)
    bases = [pick.getrandbits(63) for _ in range(30)]
    hashes = [pick.choice(bases) ^ sum(1 << b for b in pick.sample(range(63), pick.randrange(9))) for _ in range(400)]
    index = hash_index.HashIndex(spark, f"{folder}/index", expected=800)
    got = {}
    for batch in range(2):
        some = spark.createDataFrame(list(enumerate(hashes))[batch * 200 : batch * 200 + 200], "record_id long, phash long")
        near = photos.duplicate_distance(some, index=index, before=batch)
        got.update((r["record_id"], r["min_distance"]) for r in near.collect())
        stored = photos.stored_hashes(some)
        assert index.append(stored, batch)
        index = hash_index.HashIndex(spark, f"{folder}/index", expected=800)  # as a batch after a restart finds it
        assert not index.listed and index.table.scan(before=None).count() <= (batch + 1) * 200
    want = {}
    for i, h in enumerate(hashes):
        nearest = min(((h ^ other).bit_count() for other in hashes[:i]), default=99)
        if nearest <= 6:
            want[i] = nearest
    assert got == want
    small = hash_index.HashIndex(spark, f"{folder}/small", expected=10**6)
    small.append(stored, 0)
    assert small.listed


def test_rows_that_are_merged_are_not_merged_again(spark, folder):
    calls = []

    def merge(rows):
        calls.append(rows)
        return segments.newest(["id"], ["v"])(rows)

    table = segments.SegmentTable(spark, f"{folder}/table", merge, ["id"], merged=True)
    table.append(rows(spark, (1, 1, "a"), (2, 1, "b")), 0)
    assert state(table) == {1: (1, "a"), 2: (1, "b")} and not calls
    table.append(rows(spark, (1, 2, "c")), 1)
    assert state(table) == {1: (2, "c"), 2: (1, "b")} and len(calls) == 1
