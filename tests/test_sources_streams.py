"""File formats, refusals, and stream = batch."""

import collections
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basinlens import constants
from basinlens.operators import integrity, photos, records, registry, scoring
from basinlens.plans.tables import Tables
from basinlens.sources import files, geojson, report_html, segments
from basinlens.streaming import ingest, live_counts, photo_state

PAGE = """<table id="t"><thead><tr><td>not in the body</td></tr></thead><tbody>
<tr><th>1</th><th>2</th></tr>
<tr><td colspan="7"><b>NRM</b></td></tr>
<tr><td>1</td><td><a href="x?w=1&amp;v=2">P1</a> <a href='last?dcode=296&distname=A+B'>more</a></td><td>H</td><td>Farm
   Pond &amp; bund</td><td>Accepted</td><td></td><td>Yet to Moderate</td></tr>
<tr><td colspan="7"> </td></tr>
<tr><TD>2</TD><TD>P2</TD><TD>H</TD><TD>Goatery</TD><TD>Accepted Rejected</TD><TD>x</TD><TD>Rejected</TD></tr>
<tr><td colspan=7>EPA</td></tr>
<tr><td>3</td><td></td><td>H</td><td>Skipped: no code</td><td></td><td></td><td></td></tr>
<tr><td>total</td><td>9</td></tr>
</tbody></table><table><tr><td>outside</td></tr></table>"""


def test_report_page(spark, folder):
    with open(f"{folder}/page.html", "w") as f:
        f.write(PAGE)
    rows = report_html.table_rows(report_html.read_pages(spark, f"{folder}/*.html")).orderBy("row").collect()
    assert [r["group"] for r in rows] == ["NRM", "NRM", "EPA", "EPA"]
    assert rows[0]["cells"][1]["href"] == "last?dcode=296&distname=A+B" and rows[0]["cells"][3]["text"] == "Farm Pond & bund"
    work = registry.workcode_rows(report_html.table_rows(report_html.read_pages(spark, folder))).orderBy("row").collect()
    assert [w["work_code"] for w in work] == ["P1 more", "P2"]
    assert [(w["pre_slug"], w["mid_slug"], w["post_slug"]) for w in work] == [("accepted", "not_submitted", "yet_to_moderate"), ("mixed", "other", "rejected")]
    assert [w["category"] for w in work] == ["PT", "LS"]


def test_json_array_and_summaries(spark, folder):
    schema = T.StructType([T.StructField("id", T.StringType())])
    with open(f"{folder}/m.json", "w") as f:
        json.dump([{"id": "a"}, {"id": "b"}], f, indent=1)
    assert files.read_json_array(spark, f"{folder}/m.json", schema).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_json_array(spark, f"{folder}/none.json", schema).count()
    assert files.read_summaries(spark, f"{folder}/benchmark_summary_*.json").count() == 0
    for model, n in (("one", 0), ("two", 5)):
        with open(f"{folder}/benchmark_summary_{model}.json", "w") as f:
            json.dump({"model": model, "n_photos": n, "confusion_matrix": {"PT": {"PT": n}}}, f, indent=1)
    out = {r["model"]: (r["file"], r["accuracy_status"]) for r in files.read_summaries(spark, f"{folder}/benchmark_summary_*.json").collect()}
    assert out == {"one": ("benchmark_summary_one.json", "not_established"), "two": ("benchmark_summary_two.json", "measured")}


def test_csv_keeps_nulls_quotes_and_breaks(spark, folder):
    values = [("P,1", "h", 'say "x"', "PT", "", None, "line\\ one", "u", "t")]
    df = spark.createDataFrame(values, ", ".join(f"{c} string" for c in files.REGISTRY_COLUMNS))
    files.write_registry_csv(df, f"{folder}/csv", "u", "t")
    assert tuple(files.read_registry_csv(spark, f"{folder}/csv").first()) == values[0]


def test_box_scan_is_pushed_down(spark, folder):
    df = spark.range(1000).select("id", *[(F.col("id") / 10).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    df.write.parquet(f"{folder}/boxes")
    scan = files.scan_box(spark, f"{folder}/boxes", (10.0, 10.0, 20.0, 20.0), ["id"])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(xmin,20.0)" in plan and scan.count() == 101


def test_geojson_kinds(spark):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    shapes = [
        {"type": "Polygon", "coordinates": [ring]},
        {"type": "MultiPolygon", "coordinates": [[ring], [[[5, 5], [6, 5], [6, 6]]]]},
        {"type": "Point", "coordinates": [0, 0]},
    ]
    lines = [(json.dumps({"type": "Feature", "properties": {"id": str(i)}, "geometry": g}),) for i, g in enumerate(shapes)]
    good, bad = geojson.parse_features(spark.createDataFrame(lines, "value string"), {"id": "string"})
    edges = geojson.parts_to_edges(good, "id").groupBy("id", "part").count().orderBy("id", "part").collect()
    assert [tuple(r) for r in edges] == [("0", 0, 3), ("1", 0, 3), ("1", 1, 3)]  # the open ring is closed
    assert bad.first()["reason"] == "boundary must be Polygon or MultiPolygon, got Point"


def test_updates_refuse_unknown_rows(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    good = records.patch_columns(target, spark.createDataFrame([("a", None)], "id string, v int"), "id", ["v"])
    assert {tuple(r) for r in good.collect()} == {("a", None), ("b", 2)}
    with pytest.raises(Exception, match="no row to update: zz"):
        records.patch_columns(target, spark.createDataFrame([("zz", 1)], "id string, v int"), "id", ["v"]).collect()
    cands = spark.createDataFrame([("p1", "m", 0), ("p2", "m", 1)], "polygon_id string, mws_code string, pos int")
    entries = spark.createDataFrame([("p1",), ("m",)], "entry string")
    got = {r["entry"]: r["polygon_id"] for r in records.resolve_entries(entries, cands, "polygon_id", "mws_code").collect()}
    assert got == {"p1": "p1", "m": "p2"}
    with pytest.raises(Exception, match="entry not found"):
        records.resolve_entries(spark.createDataFrame([("x",)], "entry string"), cands, "polygon_id", "mws_code").collect()


def test_first_match_errors(spark):
    recs = spark.createDataFrame([(1,), (2,), (3,)], "record_id long")
    results = spark.createDataFrame([(1, 5, "9"), (1, 2, "30"), (2, 0, "1.5")], "record_id long, pos long, satellite_score string")
    out = {r["record_id"]: (r["satellite_score"], r["match_error"]) for r in records.first_match(recs, results).collect()}
    assert out == {1: (30, None), 2: (None, "missing a valid integer satellite_score"), 3: (None, "no precomputed result")}


def split_files(spark, df, path, parts):
    """The rows as several files with ascending ids, so a stream sees several batches."""
    rows = df.orderBy(df.columns[0]).collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_ingest_equals_batch(spark, folder):
    """Five files in shuffled order: each photo is compared with all that came before, in arrival order."""
    t = Tables(spark, "/root/testdata/sf0.001")
    now = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    extra = {"is_synthetic": F.lit(False), "photo_source": F.lit(None).cast("string")}
    arriving = t.records.withColumns(extra).limit(600)
    all_photos = t.photos().persist()
    # arrival renames records, so that ids ascend with arrival although their photos lie all over the files
    order = random.Random(3).sample([r[0] for r in arriving.select("record_id").collect()], 600)
    place = spark.createDataFrame(list(enumerate(order)), "place bigint, record_id bigint")
    renamed = arriving.join(place, "record_id").withColumn("record_id", F.col("place")).drop("place").select(*arriving.columns)
    photo_rows = all_photos.join(place, "record_id").select(F.col("place").alias("record_id"), "phash").persist()
    split_files(spark, renamed, f"{folder}/in", 5)
    body = ingest.ingest_batch(
        spark, t.mws, t.edges, lambda b: photo_rows.join(b.select("record_id"), "record_id", "left_semi"), f"{folder}/out", now, blocks=7
    )
    stream = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    ingest.start_ingest(stream, body, f"{folder}/state").awaitTermination()
    scored = spark.read.parquet(f"{folder}/out/scored")
    assert scored.select("batch_id").distinct().count() == 5
    stored = spark.read.parquet(f"{folder}/in")
    batch, _ = integrity.ingest(stored, t.mws, t.edges, photo_rows.join(stored.select("record_id"), "record_id", "left_semi"), now, blocks=7)
    want = {tuple(r) for r in batch.select("record_id", "geo_score").collect()}
    assert {tuple(r) for r in scored.select("record_id", "geo_score").collect()} == want
    assert {tuple(r) for r in ingest.current_records(spark, f"{folder}/out").select("record_id", "geo_score").collect()} == want
    # a batch that comes again after a crash leaves everything as it was
    body(spark.read.parquet(f"{folder}/in").where("record_id >= 480"), 4)
    again = spark.read.parquet(f"{folder}/out/scored")
    assert {tuple(r) for r in again.select("record_id", "geo_score").collect()} == want
    assert ingest.current_records(spark, f"{folder}/out").count() == 600


def photo_stream(spark, df, folder, parts, **options):
    """Least distances found by the keyed state over ``parts`` micro-batches."""
    split_files(spark, df, f"{folder}/in", parts)
    own = photo_state.state_session(spark)
    stream = own.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = photo_state.stream_duplicates(stream, **options).writeStream.format("parquet")
    q = q.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    if "expire_ms" in options:  # timers keep such a stream going
        running = q.start()
        running.awaitTermination(12)
        running.stop()
    else:
        q.trigger(availableNow=True).start().awaitTermination()
    found = photo_state.least_distances(spark.read.schema(photo_state.OUTPUT).parquet(f"{folder}/out"))
    return {tuple(r) for r in found.collect()}


def test_keyed_photo_state_equals_batch(spark, folder):
    """Both photos of each record, some records with one photo twice, over four micro-batches."""
    df = Tables(spark, "/root/testdata/sf0.001").photos().where("phash is not null").limit(400)
    df = df.unionByName(df.where("record_id % 50 = 0")).orderBy("record_id").persist()
    want = {tuple(r) for r in photos.duplicate_distance(df, blocks=7).collect()}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert photo_stream(spark, df, folder, 4, blocks=7) == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_a_hot_block_moves_to_the_second_level(spark, folder):
    """A third of all hashes share 53 bits: their first-level keys overflow, in a batch or over several."""
    pick = random.Random(8)
    hot = pick.getrandbits(63) & ~0x7FF
    values = [hot | pick.getrandbits(11) if i % 3 == 0 else pick.getrandbits(63) for i in range(900)]
    values += [values[i] ^ (1 << pick.randrange(63)) for i in range(0, 900, 9)] + [values[3]] * 40
    df = spark.createDataFrame(list(enumerate(values)), "record_id long, phash long")
    want = {}
    for i, h in enumerate(values):
        nearest = min(((h ^ other).bit_count() for other in values[:i]), default=99)
        if nearest <= 6:
            want[i] = nearest
    assert photo_stream(spark, df, f"{folder}/a", 4, blocks=7, bound=60) == set(want.items())
    assert photo_stream(spark, df, f"{folder}/b", 1, blocks=7, bound=60) == set(want.items())


def test_blocks_follow_the_expected_number_of_hashes():
    few, many = (photos.choose_blocks(n, row_cost=photo_state.ROW_COST) for n in (10_000_000, 10_000_000_000))
    assert few == 7 and many > 7
    masks = photo_state.second_masks(7, 6)
    # each choice opens other bits than its first key, and together they cover all that it leaves open
    for kept, opened in zip(photos.block_masks(7, 6), masks.tolist(), strict=True):
        union = 0
        for mask in opened:
            assert mask & (kept % 2**64) == 0
            union |= mask
        assert union | (kept % 2**64) == 2**64 - 1


def test_forgotten_photos_make_no_duplicates(spark, folder):
    df = spark.createDataFrame([(1, 5), (2, 5)], "record_id long, phash long")
    assert photo_stream(spark, df, f"{folder}/kept", 2, blocks=7, expire_ms=600_000) == {(2, 0)}
    assert photo_stream(spark, df, f"{folder}/lost", 2, blocks=7, expire_ms=1) == set()


def test_late_rows_leave_the_counts(spark, folder):
    def put(day, n):
        rows = [(dt.datetime(2024, 1, day), "k")] * n
        spark.createDataFrame(rows, "ts timestamp_ntz, key string").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run():
        stream = spark.readStream.schema("ts timestamp_ntz, key string").parquet(f"{folder}/in")
        counts = live_counts.windowed_counts(stream, ["key"], late="2 days")
        live_counts.keep_latest(counts, f"{folder}/out", f"{folder}/state", ["key"]).awaitTermination()
        now = live_counts.current_counts(spark.read.parquet(f"{folder}/out"), ["key"])
        return {r["window_start"].day: r["n"] for r in now.collect()}

    put(10, 3)
    assert run() == {10: 3}
    put(20, 2)
    assert run() == {10: 3, 20: 2}
    put(19, 1)  # within the allowed delay
    put(10, 5)  # too late
    assert run() == {10: 3, 19: 1, 20: 2}


def test_paged_collections_are_whole(spark):
    df = spark.range(250).select(F.col("id").alias("record_id"), F.lit("w").alias("mws_id"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"))
    pages = geojson.feature_collections(df, "mws_id", ["record_id"], "record_id", 100).collect()
    seen = [f["properties"]["record_id"] for p in pages for f in json.loads(p["collection"])["features"]]
    assert sorted(seen) == list(range(250)) and max(p["n_features"] for p in pages) == 100


def test_nested_series_documents(spark):
    rows = [("p", "NDVI", 2020, 0.5), ("p", "NDVI", 2019, None), ("p", "MNDWI", 2020, 0.1)]
    df = spark.createDataFrame(rows, "polygon_id string, index string, year int, value double")
    doc = files.series_documents(df, {"source": "s"}).first()
    assert doc["series"] == {"NDVI": {"2019": None, "2020": 0.5}, "MNDWI": {"2020": 0.1}} and doc["source"] == "s"


def test_stored_hash_counts(spark):
    df = spark.createDataFrame([(3, 7), (1, 7), (2, None)], "record_id long, phash long")
    assert [tuple(r) for r in photos.stored_hashes(df).collect()] == [(7, 1, 3, 2)]


def test_live_counts_follow_changes(spark, folder):
    """Several batches with updates, resent and retracted records; equal to counting the newest rows."""
    pick, out = random.Random(2), f"{folder}/out"
    body = live_counts.count_batch(spark, out, "record_id", "version", "groups", range_rows=10)
    newest: dict = {}
    schema = "record_id long, version int, groups array<string>"
    for batch in range(6):
        rows = [(pick.randrange(30), pick.randrange(4), pick.choice([None, [], ["a"], ["a", "b"], ["b", "c"], ["c", None]])) for _ in range(20)]
        rows += [(None, 9, ["a"]), (3, None, ["b"])]
        for record, version, groups in rows:
            if record is not None and version is not None:
                offered = (version, sorted(g for g in groups or [] if g is not None))
                newest[record] = max(newest.get(record, offered), offered)
        df = spark.createDataFrame(rows, schema)
        body(df, batch)
        body(df, batch)  # again, as after a crash
        want = collections.Counter(g for _, groups in newest.values() for g in groups)
        assert {r["group"]: r["n"] for r in live_counts.current_sums(spark, out).collect()} == dict(want)


def test_live_counts_survive_a_crash_between_their_tables(spark, folder, monkeypatch):
    out = f"{folder}/out"
    body = live_counts.count_batch(spark, out, "record_id", "version", "groups")
    df = spark.createDataFrame([(1, 1, ["a"])], "record_id long, version int, groups array<string>")
    append = segments.SegmentTable.append

    def crash(self, rows, batch=None, meta=None):
        if self.path.endswith("records"):
            raise OSError("lost")
        return append(self, rows, batch, meta)

    with monkeypatch.context() as broken:
        broken.setattr(segments.SegmentTable, "append", crash)
        with pytest.raises(OSError, match="lost"):
            body(df, 0)
    body(df, 0)
    body(spark.createDataFrame([(1, 2, ["b"])], df.schema), 1)
    assert {r["group"]: r["n"] for r in live_counts.current_sums(spark, out).collect()} == {"b": 1}


def test_live_backlog_equals_backlog_and_bands(spark, folder):
    """Updates that change status and band, over three batches, against the batch operators on the newest rows."""
    pick, slugs, bands = random.Random(6), constants.STATUS_SLUGS, [None, *constants.BANDS]
    body = live_counts.count_batch(spark, f"{folder}/out", "record_id", "version", "groups")
    newest = {}
    schema = "record_id long, version int, mws_id string, band string, pre_slug string, mid_slug string, post_slug string"
    for batch in range(3):
        rows = [(r, batch, f"W{r % 4}", pick.choice(bands), *(pick.choice(slugs) for _ in range(3))) for r in pick.sample(range(60), 40)]
        newest |= {r[0]: r for r in rows}
        body(spark.createDataFrame(rows, schema).withColumn("groups", live_counts.status_groups()), batch)
    live = {(r["kind"], r["name"], r["value"]): r["n"] for r in live_counts.split_group(live_counts.current_sums(spark, f"{folder}/out")).collect()}
    now = spark.createDataFrame(list(newest.values()), schema)
    for row in registry.stage_backlog(now).collect():
        assert [live.get(("stage", row["stage"], s), 0) for s in slugs] == [row[s] for s in slugs]
    for row in scoring.band_stats(now, now).collect():
        assert [live.get(("band", row["mws_id"], b), 0) for b in [*constants.BANDS, "unscored"]] == [row[b] for b in [*constants.BANDS, "unscored"]]


def test_evenly_spread_hashes_stay_at_the_first_level():
    """At 60 times sf0.1 every key went over the bound, and 196 rows per hash to the second level."""
    for expected in (18_000_000, 108_000_000):
        blocks = photos.choose_blocks(expected, row_cost=photos.GROUP_COST)
        assert expected / 2 ** (64 // blocks) <= 2 * photo_state.BOUND


def test_many_new_hashes_of_a_key_are_looked_up_by_longer_keys(spark, folder, monkeypatch):
    monkeypatch.setattr(photo_state, "DIRECT", 0)
    pick = random.Random(12)
    values = [pick.getrandbits(63) for _ in range(250)]
    values += [pick.choice(values) ^ sum(1 << b for b in pick.sample(range(63), pick.randrange(9))) for _ in range(350)]
    pick.shuffle(values)
    want = {}
    for i, h in enumerate(values):
        nearest = min(((h ^ other).bit_count() for other in values[:i]), default=99)
        if nearest <= 6:
            want[i] = nearest
    df = spark.createDataFrame(list(enumerate(values)), "record_id long, phash long")
    assert photo_stream(spark, df, folder, 3, blocks=9) == set(want.items())


def test_a_cell_is_cleaned_once_whatever_it_holds(spark):
    """Decoding wrote its argument three times into the plan, and lambdas evaluate each of them."""
    from basinlens.sources.report_html import cell_text

    df = spark.createDataFrame([("<b>a</b> &amp;lt; &#65;&#x42; &nope; &#xZZ; &",), ("plain",), (None,)], "t string")
    out = df.select(cell_text(F.col("t")).alias("t"))
    assert [r["t"] for r in out.collect()] == ["a &lt; AB &nope; &#xZZ; &", "plain", None]
    assert out._jdf.queryExecution().analyzed().toString().count("<[^>]*>") == 1
