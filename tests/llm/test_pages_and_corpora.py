"""Pages, licences, URLs, fingerprints, mixing, quality, neighbours and the pipeline."""

import collections
import hashlib
import html
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from basinlens.llm import fingerprints, html_text, license_scan, mixing, neighbours, quality, queries, url_filter
from basinlens.llm.common import table

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(30_000))


def test_every_operator_is_registered():
    names = {re.match(r"op(\d+)_", n)[1] for n in entry.queries() if n.startswith("op")}
    assert names == {str(i) for i in range(1, 14)} and "pipeline" in entry.queries()


def test_labelled_pages_are_told_apart():
    tree = html_text.trained_tree()
    for page in html_text.LABELLED_PAGES:
        blocks, want = html_text.labelled_blocks(page)
        assert [tree.says(r) for r in html_text.features_of(blocks).tolist()] == want


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="post">
<header><a href="/">Site</a></header><nav><ul><li>Menu</ul></nav><div id=cookieBanner>We use cookies</div>
<div class="layout with-sidebar"><main><header><h1>T &amp;amp; C</h1></header><p>One <a href="x>y">link</a>&nbsp;and
 &eacute;&#233; <!-- <p>no --> text.<p>Two<br>lines<aside>no</aside><form><p>no<input></form><table><tr><td>c1<td>c2</table>
<ul><li><a>all link</a></ul><div class="share-buttons">no</div><p>Ok</p></main><div class=sidebar><p>no no no</p></div></div>
<section id="comments"><article><p>a reader's comment of some length, which is not the article</p></article></section>
<footer>&copy; no</footer></body></html>"""


def test_page_with_all_kinds_of_blocks():
    text = html_text.main_text(PAGE, html_text.trained_tree())
    assert text == "T &amp; C\nOne link and éé text.\nTwo lines\nc1\nc2\nall link\nOk"


def test_articles_are_not_lost():
    tree = html_text.trained_tree()
    words = "A sentence of the article that says a little more than its title does."
    body = f"<h1>Title</h1>{{}}<p>{words}</p><p>{words} {words}</p>"
    want = f"Title\n{words}\n{words} {words}"
    for inside in ("<svg/>", "<svg viewBox='0 0 1 1' />", "<video-player src=x></video-player>", "<map-view>", "<button>", "<select>", "<script src='a.js'/>", "<p><button>no</button>"):
        assert html_text.main_text(f"<nav><a>Home</a></nav><article>{body.format(inside)}</article><footer>end</footer>", tree) == want, inside
    for start in ("data-id='ad-12'", "data-role=advert", "class='post related-to-x'", "class='category-legal post'", "title='a notice of class=ad'", "class=tag-newsletter"):
        assert html_text.main_text(f"<nav><a>Home</a></nav><article {start}>{body.format('')}</article><footer>end</footer>", tree) == want, start
    page = f"<div class='layout with-sidebar'><div><a>Home</a></div>{body.format('')}<p>{words}</p><div class=sidebar><p>no {words}</p></div></div>"
    assert html_text.main_text(page, tree) == f"{want}\n{words}"
    for lost in ("class=comment", "class='promo advert'", "hidden", "id=cookieNotice"):
        assert html_text.main_text(f"<main>{body.format('')}<article {lost}><p>{words}</p></article></main>", tree) == want, lost
    assert html_text.main_text("<article><p>One</p>" + "<button>" * 5000 + "<p>Two</p></article>", tree) == "One\nTwo"


def test_pages_of_a_table(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op1_html_text(spark, FOLDER).collect()}
    for r in table(spark, FOLDER, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))


def test_pages_at_the_edges(spark):
    pages = [(1, "u", None, 0), (None, None, "", 0), (2, "u", "<p>" + "x " * 50 + "<" * 50, 0), (2, "u", "<article>a<script>", 0)]
    pages += [(3, "u", "<article>" + "<div>" * 3000 + f"<p>{LONG}", 0)]
    rows = html_text.extract(spark.createDataFrame(pages, "page_id int, url string, html string, n_chars int")).collect()
    got = {(r.page_id, i): r.text for i, r in enumerate(rows)}
    assert [got[k] for k in sorted(got, key=lambda k: k[1])][:2] == ["", ""] and rows[3].text == "a" and rows[4].text == LONG
    assert html_text.extract(spark.createDataFrame([], "page_id int, url string, html string")).collect() == []


def test_urls_equal_sql_and_edges(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{FOLDER}/pages.parquet'")
    want = con.sql(queries.CHECKS["op7_url_filter"]).fetchall()
    df = queries.op7_url_filter(spark, FOLDER).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)

    urls = {None: ("", "", None, "allow"), "": ("", "", None, "allow"), "net/x": ("", "", None, "allow"), "http:///": ("", "/", None, "allow"),
            "HTTP://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"), "x://net": ("net", "", None, "allow"),
            "x://example.net/EN/": ("example.net", "/EN/", "net/", "block"), "x://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
            "x://a.org/fr/#": ("a.org", "/fr/", "org/fr/", "allow"), "x://free-bets.org/": ("free-bets.org", "/", None, "block"),
            "x://freebets.ÉA?a/b": ("freebets.Éa", "", None, "allow"), "x://" + "a." * 200 + "net/": ("a." * 200 + "net", "/", "net/", "block")}
    rows = [(i, u, "old") for i, u in enumerate([*urls, "x://net/", "x://net/"])]
    frame = spark.createDataFrame(rows, "page_id int, url string, verdict string")
    rules = spark.createDataFrame([*url_filter.RULES, url_filter.RULES[0], (None, "block")], "rule string, verdict string")
    got = {r.page_id: (r.url, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(frame, rules, blocked_words=url_filter.BLOCKED_WORDS).collect()}
    assert got == {i: (u, *urls.get(u, ("net", "/", "net/", "block"))) for i, u, _ in rows}
    assert url_filter.judge(frame.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.judge(frame, rules.limit(0)).collect()} == {"allow"}


def test_rules_of_many_path_lengths(spark):
    made = [(f"x.org/{'a' * n}", "block" if n % 2 else "allow") for n in range(70)]
    frame = spark.createDataFrame([(n, f"http://w.x.org/{'a' * n}/end") for n in (0, 1, 33, 64, 69, 90)], "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(frame, spark.createDataFrame(made, "rule string, verdict string")).collect()}
    assert got == {n: made[min(n, 69)] for n in (0, 1, 33, 64, 69, 90)}


def test_cascade_is_exact_and_falls_back(spark, monkeypatch):
    keys = spark.range(6000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), (F.col("id") % 3 == 0).alias("listed"))
    cascade = url_filter.build_cascade(keys)
    rows = keys.toPandas()
    assert (cascade.contains(rows.h1.to_numpy(), rows.h2.to_numpy()) == rows.listed.to_numpy()).all() and len(cascade.levels) > 2
    pages = table(spark, FOLDER, "pages").select("page_id", "url")
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    want = sorted(map(tuple, url_filter.judge(pages, rules, blocked_words=["ads"]).collect()))
    monkeypatch.setattr(url_filter, "MAX_BITS", 0)
    assert sorted(map(tuple, url_filter.judge(pages, rules, blocked_words=["ads"]).collect()), key=str) == sorted(want, key=str)


def test_licences(spark):
    assert all(any(a in t.lower() for a in license_scan.ANCHORS) for f, ts in license_scan.STATEMENTS.items() for t in ts)
    texts = ["x\nThis work is licensed under the GNU General Public License, version 3.\ny", "He lost his license to drive a car", None, "", "Released under the MIT License.",
             "the court gave permission to build", "CREATIVE COMMONS Attribution-ShareAlike 4.0 license", "Released under the MIT License.", LONG + "\nAll rights reserved."]
    frame = spark.createDataFrame([(None if i == 4 else i, t, "z", 1) for i, t in enumerate(texts)], "doc_id int, text string, family string, line int")
    got = {(r.doc_id, r.line): (r.family, r.confirmed) for r in license_scan.scan(frame).collect()}
    assert {k for k, v in got.items() if v[1]} == {(0, 1), (None, 0), (6, 0), (7, 0), (8, 1)}
    assert [got[k][0] for k in [(0, 1), (None, 0), (6, 0), (7, 0), (8, 1)]] == ["GPL", "MIT", "CC-BY-SA", "MIT", "reserved"]
    assert set(got) == {(0, 1), (1, 0), (None, 0), (5, 0), (6, 0), (7, 0), (8, 1)}
    assert license_scan.scan(frame.limit(0)).collect() == []


def test_licences_without_anchors_and_over_lines(spark):
    telling = set(license_scan.telling_words())
    statements = [t for f, ts in license_scan.STATEMENTS.items() if f != license_scan.UNKNOWN for t in ts]
    assert all(telling & set(re.split(r"[\W_]+", t.lower())) for t in statements)
    plain = ["Released under CC BY-SA 4.0", "GPL-3.0-or-later", "Released under the GPL, version 2 or later", "Provided as is, without warranty of any kind",
             "Alle Rechte vorbehalten"]
    prose = "\n".join(f"w{i} of the w{i + 1} and w{i + 2}" for i in range(60))
    wrapped = "This work is licensed under the\nGNU General Public\nLicense, version 3."
    texts = [*plain, wrapped, f"{prose}\n{wrapped}\n{prose}", f"{prose}\n\n  \n{wrapped}\n\n{prose}", prose, "Her work was of the\nfree kind in the town"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.line): r.family for r in license_scan.scan(frame).collect() if r.confirmed}
    assert [got.get((i, 0)) for i in range(5)] == ["CC-BY-SA", "GPL", "GPL", "MIT", "reserved"]
    assert {k[0] for k, family in got.items() if family == "GPL"} == {1, 2, 5, 6, 7} and not {k[0] for k in got} & {8, 9}
    assert (got[5, 0], got[7, 62]) == ("GPL", "GPL")


def bag(text):
    return collections.Counter(w for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w)


def test_fingerprints(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, FOLDER, "documents").collect()}
    ids = sorted(docs)
    errors = []
    rows = {r.doc_id: r for r in queries.op8_fingerprints(spark, FOLDER).collect()}
    by_text = {}
    for i, k in enumerate(ids):
        text, following = docs[k], docs[ids[(i + 1) % len(ids)]]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        r = rows[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            a, b = bag(text), bag(other)
            errors.append(near - sum((a & b).values()) / max(1, sum((a | b).values())))
    # unbiased: the mean error is within five standard errors of 64 samples
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_fingerprints_at_the_edges(spark):
    pairs = [(3, "a b"), (None, None), (3, "a b"), (3, "c d é"), (1, ""), (2, LONG)]
    frame = spark.createDataFrame([(i, t, 9) for i, t in pairs], "doc_id bigint, text string, n_chars int")
    rows = fingerprints.fingerprint_with_edits(frame).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in rows) == sorted((str(i), len(t or "")) for i, t in pairs)
    empty = [r for r in rows if r.n_chars == 0]
    assert all(r.fingerprint == "-" * 64 and r.near_edited == 1.0 for r in empty)
    assert len({r.fingerprint for r in rows if r.n_chars == 3}) == 1
    one = fingerprints.fingerprint_with_edits(frame.where("doc_id = 2")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256((LONG[: len(LONG) - len(LONG) // 4] + LONG[: len(LONG) // 4]).encode()).hexdigest()
    assert fingerprints.fingerprint_with_edits(frame.limit(0)).collect() == []


@pytest.mark.parametrize("blocks", [[1], [5, 3, 2], [1, 1, 7], [100, 1, 50, 17, 3], [40] * 9 + [333]])
def test_pfair_stays_within_a_block(blocks):
    order = mixing.pfair_order(blocks)
    at = np.arange(1, len(order) + 1)
    for s, n in enumerate(blocks):
        assert (order == s).sum() == n
        assert np.abs(np.cumsum(order == s) - n * at / len(order)).max() < 1


def test_mixture(spark):
    rows = [(i, "hot" if i % 3 else ("a", "b", None)[i % 4 % 3], 5) for i in range(900)] + [(1, "hot", 5)] * 2
    frame = spark.createDataFrame(rows, "doc_id int, source string, slot int")
    out = mixing.mix(frame, weights={"hot": 0.5, "a": 0.3}, block_rows=8).toPandas().sort_values("position")
    assert out.position.tolist() == list(range(len(out)))
    natural = collections.Counter((r[0], r[1]) for r in rows)
    got = collections.Counter(zip(out.doc_id, out.source.where(out.source.notna(), None), strict=True))
    assert set(got) == set(natural) and all(got[k] >= n for k, n in natural.items())
    hot, a = (out.source == "hot").mean(), (out.source == "a").mean()
    assert abs(hot / a - 5 / 3) < 0.1 and out.pass_no.max() < 4
    slots = out.drop_duplicates("slot")
    for name in ("hot", "a"):
        here = (slots.source == name).to_numpy()
        assert np.abs(np.cumsum(here) - here.mean() * np.arange(1, len(here) + 1)).max() < 1
    ordered = mixing.mix(frame, ordered=True).select("position").collect()
    assert [r.position for r in ordered] == list(range(len(ordered)))
    assert mixing.mix(frame.limit(0)).collect() == []


def test_mixture_holds_weights_of_small_sources(spark):
    frame = spark.createDataFrame([(i, "a") for i in range(600)] + [(600 + i, "b") for i in range(2)], "doc_id int, source string")
    counts = mixing.mix(frame, weights={"a": 0.5, "b": 0.5}).groupBy("source", "doc_id").count().groupBy("source").agg(F.sum("count"), F.min("count")).collect()
    assert sorted(map(tuple, counts)) == [("a", 600, 1), ("b", 600, 300)]
    reached = {r.source: (r.rows, round(r.target, 3), round(r.reached, 3)) for r in mixing.shares(frame, weights={"a": 0.5, "b": 0.5}).collect()}
    assert reached == {"a": (600, 0.5, 0.5), "b": (600, 0.5, 0.5)}
    capped = {r.source: (r.rows, r.target, round(r.reached, 3)) for r in mixing.shares(frame, weights={"a": 1, "b": 1}, max_passes=4).collect()}
    assert capped == {"a": (600, 0.5, 0.987), "b": (8, 0.5, 0.013)}
    assert mixing.lengths([25_600_000, 10_000], [25_600_000**0.75, 10_000**0.75], None)[1] > 4 * 10_000


def test_mixture_pools_what_has_no_share_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    monkeypatch.setattr(mixing, "MAX_SLOTS", 20)
    frame = spark.createDataFrame([(i, f"s{i % 10}") for i in range(500)], "doc_id int, source string")
    out = mixing.mix(frame, block_rows=1).toPandas()
    assert set(out.doc_id) == set(range(500)) and out.slot.nunique() <= 25 and out.position.nunique() == len(out)


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    known = labels.where("doc_id % 2 = 0")
    judged = quality.assess(docs, known).join(labels.where("doc_id % 2 = 1"), "doc_id")
    right = judged.agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.98
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.join(labels.where("quality = 1"), "doc_id").count() == labels.where("quality = 1").count()


def test_site_priors_are_drawn_to_their_hosts(spark):
    rows = [("big", "p", 0.9)] * 40 + [("big", "q", 0.1)] * 40 + [("one", "p", 0.1)] + [("bad", "p", 0.1)] * 40
    sites, level = quality.site_priors(spark.createDataFrame(rows, "host string, path string, chance double"), 0.5)
    assert {(r.host, r.path): r.path_n for r in sites.collect()} == {("big", "p"): 40, ("big", "q"): 40, ("one", "p"): 1, ("bad", "p"): 40}
    assert level["path"] < 5 and 0.3 < level["overall"] < 0.4


def test_quality_at_the_edges(spark):
    pairs = [(1, None), (None, "good words here"), (2, ""), (2, ""), (3, LONG), (4, "$$$ ### %%% &&&")]
    frame = spark.createDataFrame([(i, t, None, "en", 0.5) for i, t in pairs], "doc_id bigint, text string, source string, lang string, evidence double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (4, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    rows = quality.assess(frame, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in pairs) and all(0 <= r.posterior <= 1 for r in rows)
    assert quality.keep_good(frame, labels.limit(0)).count() == len(pairs)
    assert quality.assess(frame.limit(0), labels).collect() == []


def brute_nearest(vectors, queries_, k):
    ids = [i for i, v in vectors if v is not None]
    x = np.array([v for _, v in vectors if v is not None], dtype=float)
    out = {}
    for q in queries_:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
        order = sorted((d[j], i) for j, i in enumerate(ids) if i != q)
        out[q] = order[:k]
    return out


def test_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    points = centres[rng.integers(40, size=6000)] + 0.3 * rng.normal(size=(6000, 16))
    vectors = [(i, p.tolist()) for i, p in enumerate(points)]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_nearest(vectors, range(0, 6000, 50), 10)
    assert set(got) == set(want) and all([x[0] for x in sorted(v)] == list(range(1, 11)) for v in got.values())
    found = [len({v for _, v, _ in got[q]} & {i for _, i in want[q]}) for q in want]
    assert np.mean(found) / 10 >= 0.9


def test_neighbours_at_the_edges(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 2)
    good = [(i, [float(i % 5), 1.0]) for i in range(40)] + [(100, [0.0, 1.0])] * 2
    odd = [(200, None), (300, [0.0, 0.0]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (600, [1.0, None]), (700, [1.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in good + odd], "vec_id bigint, embedding array<float>, score int")
    got = sorted(map(tuple, neighbours.nearest(frame, F.col("vec_id") % 100 == 0).collect()))
    want = [(q, n + 1, i, d) for q, best in brute_nearest(sorted(good), [0, 100], 10).items() for n, (d, i) in enumerate(best)]
    assert got == sorted(want)
    few = neighbours.nearest(frame.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(few, key=lambda r: r.rank)] == [(1, 1), (2, 2)]
    assert neighbours.nearest(frame.limit(0), F.lit(True)).collect() == []


def test_neighbours_of_an_id_with_many_rows(spark):
    pairs = [(100, [0.0, 1.0])] * 30 + [(i, [0.1 * i, 1.0]) for i in range(1, 21)]
    frame = spark.createDataFrame(pairs, "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(frame, F.col("vec_id") == 100).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got) if r.query_id == 100] == [(i, i) for i in range(1, 11)]


def test_pipeline(spark, folder):
    docs = table(spark, FOLDER, "documents")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["good_documents", "near_duplicates", "mixture", "token_ids"]
    good = corpus_pipeline.good_documents(spark, docs, FOLDER)
    twice = good.unionByName(good.limit(5)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    single = corpus_pipeline.near_duplicates(spark, twice, FOLDER)
    groups = {r.doc_id: r.component_id for r in queries.ngram_join.similar_groups(good).collect()}
    assert single.columns == docs.columns
    assert sorted(str(r.doc_id) for r in single.select("doc_id").collect()) == sorted([*(str(i) for i in set(groups.values())), "None"])
    mixed = corpus_pipeline.mixture(spark, single, FOLDER)
    assert mixed.columns == docs.columns and set(mixed.select("text").collect()) == set(single.select("text").collect())
    out = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in out.collect()} == set(groups.values())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).collect() == []


def test_mixture_with_equal_rows_and_many_passes(spark):
    """Equal rows lie together, none is lost, and positions have no gaps, whatever the blocks."""
    rows = [(i % 40, "hot", "x" * (i % 3)) for i in range(300)] + [(1, "tiny", "t")] + [(i, None, "n") for i in range(20)] + [(7, "same", "s")] * 50
    frame = spark.createDataFrame(rows, "doc_id int, source string, text string")
    for weights, block in ((None, 4), ({"hot": 1, "tiny": 2, None: 1, "same": 1}, 7), ({"tiny": 1, "hot": 1}, 64)):
        out = mixing.mix(frame, weights=weights, block_rows=block, ordered=True).toPandas()
        assert sorted(out.position) == list(range(len(out))) and list(out.position) == sorted(out.position)
        assert out.sort_values("position").slot.is_monotonic_increasing
        first = out[out.pass_no == 0]
        assert collections.Counter(zip(first.doc_id, first.source.fillna(""), first.text)) == collections.Counter((d, s or "", t) for d, s, t in rows)
        for _, some in out.groupby(out.source.fillna("")):
            assert set(some.pass_no) == set(range(some.pass_no.max() + 1))
            assert some.sort_values("position").block.is_monotonic_increasing
        assert {r.source: r.rows for r in mixing.shares(frame, weights=weights).collect()}.keys() >= {"hot"}


def test_mixture_of_the_table_equals_brute_force(spark):
    """Documents of each source by hash, cut into blocks, repeated as weights ask, blocks run in the order of the schedule."""
    docs = table(spark, FOLDER, "documents")
    hashed = docs.select("doc_id", "source", F.xxhash64(*docs.columns).alias("h"), F.sha2("text", 256).alias("digest")).collect()
    sources: dict = {}
    for row in sorted(hashed, key=lambda r: r.h):
        sources.setdefault(row.source, []).append(row)
    names = sorted(sources, key=lambda s: (-len(sources[s]), f"={s}"))
    counts = [len(sources[s]) for s in names]
    rows = mixing.lengths(counts, [n**0.75 for n in counts], None)
    streams = [[(sources[s][i % n], i // n) for i in range(r)] for s, n, r in zip(names, counts, rows, strict=True)]
    want, done = [], collections.Counter()
    for slot, s in enumerate(mixing.pfair_order([-(-r // 64) for r in rows]).tolist()):
        block = done[s]
        done[s] += 1
        want += [(row.doc_id, row.source, pass_no, block, slot, row.digest) for row, pass_no in streams[s][64 * block : 64 * block + 64]]
    got = sorted(queries.op5_mixing(spark, FOLDER).collect(), key=lambda r: r.position)
    assert [(r.doc_id, r.source, r.pass_no, r.block, r.slot, r.text_sha256) for r in got] == want
    assert [r.position for r in got] == list(range(len(want)))


def test_documents_stay_in_place_when_near_duplicates_go(spark):
    """No shuffle of whole documents where the ids that go are few, however small Spark's own limit for broadcasts is."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(5, text), (3, text + " end"), (3, text + " end"), (9, "one two"), (7, None), (None, text), (8, "a b"), (8, "c d"), (8, "c d"), (6, ""), (6, text)],
        "doc_id bigint, text string",
    )
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, kept.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == sorted([(3, text + " end"), (9, "one two"), (7, None), (None, text), (8, "a b"), (8, "c d"), (6, ""), (6, text)], key=str)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
