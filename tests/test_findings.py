"""Cases that a review has found."""

import re

import pytest
from auditlake import site_queries
from auditlake.functions import html
from auditlake.llm import components
from auditlake.operators import checks, detail, graphs, migration, redirects
from auditlake.plans import views
from auditlake.project import Config, Project
from auditlake.sources import annotated_crawl, site
from auditlake.store import new_path
from auditlake.stored import Stored
from pyspark.sql import functions as F


def test_suggestions_move_blocks_and_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(migration, "BLOCK", 10)
    words = lambda c: F.array(F.lit("all"), F.concat(F.lit("w"), F.col(c) % 7), F.concat(F.lit("x"), F.col(c)))
    kinds = spark.range(40).select(F.col("id").alias("l"), words("id").alias("os"), F.array(F.lit("all")).alias("ot"))
    cand = spark.range(5, 60).select("id", words("id").alias("cs"), F.array(F.lit("all")).alias("ct"))
    best = migration.best_of(kinds, cand)
    assert "Join" not in best._jdf.queryExecution().toString()
    got = {r.l: (round(r.best.score, 6), -r.best.minus) for r in best.collect()}
    assert got == {i: (1.0, i) if i >= 5 else (0.65, 7 + i) for i in range(40)}


def test_url_lost_twice_has_the_best_of_its_titles(spark):
    pages = spark.createDataFrame([(1, "https://n.example/x", "red fox", 1, 1, 200, 1, "text/html")], "id long, url string, title string, is_internal int, fetched int, status int, indexable int, content_type string")
    lost = spark.createDataFrame([("https://o.example/a", "red fox", "missing"), ("https://o.example/a", "blue", "broken")], "old_url string, old_title string, result string")
    assert sorted((r.target, r.score, r.reason) for r in migration.suggest(lost, pages).collect()) == [("https://n.example/x", 0.3, "broken"), ("https://n.example/x", 0.3, "missing")]


def test_reference_that_a_cut_title_left_open_is_text(spark):
    raw = spark.createDataFrame([(2, "https://a.example/x", "<html><head><title>red &amp; fox&amp</title></head><body><h1>fox &amp;&amp</h1><footer></footer></body></html>")], "page_id long, url string, html string")
    r = annotated_crawl.annotated(raw).first()
    got = html.parse_page(r.html, r.url)
    assert got["title"] == "red & fox&amp" and got["h1"][0] == "fox &&amp"
    # elsewhere such references are read as browsers do
    assert html.parse_page("<title>a &amp</title>", "https://a.example/")["title"] == "a &"


def test_link_leads_to_every_page_of_its_url(spark):
    page = "<html><body><a href='/t'>t</a></body></html>"
    rows = [(1, "https://a.example/", page, 200), (2, "https://a.example/t", "", 200), (3, "https://a.example/t", "", 404)]
    raw = spark.createDataFrame([(i, u, h, 1, 1, s, "text/html") for i, u, h, s in rows], "id long, url string, html string, is_internal int, fetched int, status int, content_type string")
    p = site.build(spark, raw)
    assert sorted(map(tuple, graphs.edges(p, p["pages"], inside=False).collect())) == [(1, 2), (1, 3)]
    assert [r.detail for r in checks.run(p, ["response"]).where("check_id = 'response-broken-internal'").collect()] == ["404 — 1 inlinks"]
    # two rows, but one link
    assert p["links"].agg(F.count("*"), views.distinct_links()).first()[:] == (2, 1)
    store = Stored(spark, new_path(spark, "store"))
    store.merge(p)
    assert store.project()["links"].count() == 1


def test_old_url_is_compared_with_every_page_of_it(spark):
    rows = [(1, "https://a.example/t", "one", 200, None), (2, "https://a.example/t", "two", 404, None), (3, "https://a.example/r", "three", 301, "https://a.example/t")]
    pages = spark.createDataFrame([(i, u, t, s, r, None, 1, 1) for i, u, t, s, r in rows], "id long, url string, title string, status int, redirect_target string, canonical string, is_internal int, fetched int")
    old = pages.select("url", "status", "title", "canonical").where("id <> 2")
    got = sorted((r.old_url[-1], r.new_status, r.result) for r in migration.compare(old, pages).collect())
    assert got == [("r", 301, "broken"), ("r", 301, "redirected"), ("t", 200, "ok"), ("t", 404, "broken")]


def test_links_are_joined_in_what_lies_between_groups_only(spark, monkeypatch):
    written, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df, name: (out := cut(df, name), written.append((name, out.count())))[0])
    links = spark.range(1, 200).selectExpr("id a", "1000 b").union(spark.range(1000, 1040).selectExpr("id a", "id + 1 b"))
    assert {(r.component) for r in components.components(links).collect()} == {1}
    rounds = [n for name, n in written if name == "links"]
    assert rounds[0] == 239 and rounds[-1] == 0 and sum(rounds) < 2 * rounds[0]
    assert not any(n > 2 * rounds[0] for _, n in written)


def test_pages_are_parsed_in_small_batches(spark, monkeypatch):
    seen, parsed = [], html.parsed
    monkeypatch.setattr(site.html, "parsed", lambda raw: (seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), parsed(raw))[1])
    site.build(spark, spark.createDataFrame([(1, "https://a.example/", "", 1, 1, 200, "text/html")], "id long, url string, html string, is_internal int, fetched int, status int, content_type string"))
    assert seen == [str(site.PARSED_PER_BATCH)]


def test_every_page_of_an_url_has_its_own_walk(spark):
    import random

    rng = random.Random(6)
    rows = [(i, f"u{rng.randrange(25)}", rng.choice([200, 301, 301, 302, 404, None]), f"u{rng.randrange(28)}") for i in range(45)]
    rows += [(100 + i, f"c{i}", 301, f"c{i + 1}") for i in range(9)]
    goes = lambda r: r[2] in (301, 302)

    def walks(chain, here):
        for q in [r for r in rows if r[1] == here] or [None]:
            if here in [u for u, _ in chain]:
                yield chain, True
            elif q and goes(q):
                yield from walks([*chain, (here, q[2])], q[3])
            else:
                yield [*chain, (here, q[2] or 0 if q else 0)], False

    want = sorted((r[0], w, closed) for r in rows if goes(r) for w, closed in walks([(r[1], r[2])], r[3]))
    pages = spark.createDataFrame(rows, "id long, url string, status int, redirect_target string")
    got = sorted((r.id, [(c.url, c.status) for c in r.chain], r.is_loop) for r in redirects.chains(pages).collect())
    assert got == want and len(want) > len({i for i, _, _ in want})
    # a page shows one of its walks
    shown = {r.id: [(c.url, c.status) for c in r.redirect_chain] for r in redirects.first_chains(pages).collect()}
    assert shown == {i: min(w for j, w, _ in want if j == i) for i, _, _ in want} and redirects.first_chains(pages).count() == len(shown)


def test_counts_of_pages_that_share_an_url(spark):
    rows = [(1, "https://a.example/t", 200), (2, "https://a.example/t", 404), (3, "https://a.example/x", 200)]
    raw = spark.createDataFrame([(i, u, "", 1, 1, s, "text/html") for i, u, s in rows], "id long, url string, html string, is_internal int, fetched int, status int, content_type string")
    listed = spark.createDataFrame([("https://a.example/t",), ("https://a.example/gone",)], "url string")
    # a row that names its page is of that page, one that names none of all with its url
    ga4 = spark.createDataFrame([("https://a.example/t", 5, 1)], "url string, sessions int, page_id long")
    psi = spark.createDataFrame([("https://a.example/t", 90)], "url string, performance int")
    p = site.build(spark, raw, listed, api_ga4=ga4, api_psi=psi)
    n = {(r.view, r.filter): r.n for r in views.overview(p).collect()}
    # entries are counted, not the pages that have their urls
    assert [n["sitemaps", f] for f in (None, "in-sitemap", "orphan", "non-indexable", "not-in-sitemap")] == [2, 2, 1, 1, 1]
    assert (n["ga4", None], n["ga4", "with-data"], n["psi", "with-data"]) == (3, 1, 2)
    assert [r.id for r in views.rows(p, "ga4", "with-data").collect()] == [1]
    assert [detail.page(p, i)["api_ga4"].count() for i in (1, 2, 3)] == [1, 0, 0] and detail.page(p, 2)["api_psi"].count() == 1
    store = Stored(spark, new_path(spark, "store"))
    store.merge(p)
    assert [r.page_id for r in store.project()["api_ga4"].collect()] == [None] and views.total(store.project(), "ga4", "with-data") == 1


def test_near_copies_that_do_not_link_are_no_pairs(spark, monkeypatch):
    import random

    import numpy as np
    from auditlake.llm import jaccard_join

    rng = random.Random(10)
    sets = [np.unique(np.array(rng.sample(range(3000), rng.randrange(1, 900)), np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(40)]
    bits = [np.array(jaccard_join.sketch(s), np.int64).view(np.uint8) for s in sets]
    assert all(np.unpackbits(x ^ y).sum() <= len(np.setxor1d(s, t)) for s, x in zip(sets, bits) for t, y in zip(sets, bits))  # noqa: B905

    # pairs of copies, alike in all but four words, which is too little for a link between two pairs
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(40):
        own = list(base)
        for k in range(4):
            own[rng.randrange(10 + 45 * k, 45 + 45 * k)] = f"x{i}-{k}"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:-1]))]
    made, verify = [], jaccard_join.verify
    monkeypatch.setattr(jaccard_join, "verify", lambda pairs, parts: (made.append(pairs.count()), verify(pairs, parts))[1])
    got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    grams = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t in rows]
    want = list(range(80))
    for i in range(80):
        for j in range(i):
            if want[i] != want[j] and 100 * len(grams[i] & grams[j]) >= 75 * len(grams[i] | grams[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    assert got == dict(enumerate(want)) and len(set(want)) > 20
    assert made[-1] < 200, made


def test_rules_hold_little_of_a_batch_at_once():
    import tracemalloc

    import pyarrow as pa
    from auditlake.llm import quality, words

    text = " ".join(f"word{i % 977} of line {i}" for i in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 700)], ["text"])
    assert batch.nbytes > 4 << 20
    tracemalloc.start()
    for _, data, offsets in words.runs(iter([batch])):
        found = words.find_words(data, offsets)
        assert quality.base(data, offsets, found)["n_words"].sum() == 1600 * (len(offsets) - 1)
        assert all(len(bucket) for bucket, _ in quality.features(data, offsets, found))
    peak = tracemalloc.get_traced_memory()[1] >> 20
    tracemalloc.stop()
    assert peak < 110, peak


def test_issues_of_pages_that_share_an_url(spark):
    page = "<html><head><link rel=alternate hreflang=en href='/t'><link rel=alternate hreflang=x-default href='/t'></head><body></body></html>"
    rows = [(1, "https://a.example/", page, 200), (2, "https://a.example/t", "", 404), (3, "https://a.example/t", "", 404), (4, "https://a.example/t", "", 500), (5, "https://a.example/x", "", 200), (6, "https://a.example/x", "", 200)]
    raw = spark.createDataFrame([(i, u, h, 1, 1, s, "text/html") for i, u, h, s in rows], "id long, url string, html string, is_internal int, fetched int, status int, content_type string")
    # an entry that names its page lists that page, one that names none every page of its url
    named = spark.createDataFrame([("https://a.example/x", 6), ("https://a.example/t", None), ("https://a.example/x", 1)], "url string, page_id long")
    p = site.build(spark, raw, named)
    assert {r.id: r.in_sitemap for r in p["pages"].collect()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 1}
    assert sorted(r.page_id for r in checks.run(p, ["sitemaps"]).where("check_id = 'sitemap-missing-indexable'").collect()) == [1, 5]
    # an alternate leads to every page of its url, each once, the last first
    assert [r.detail for r in checks.run(p, ["hreflang"]).where("check_id = 'hreflang-to-broken'").collect()] == ["https://a.example/t (HTTP 500), https://a.example/t (HTTP 404), https://a.example/t (HTTP 404)"]
    store = Stored(spark, new_path(spark, "store"))
    store.merge(p)
    assert [r.page_id for r in store.project()["sitemap_urls"].collect()] == [None, None]


def test_audit_takes_no_tables_through_the_driver(spark):
    d, page = new_path(spark, "few"), "<html><head><title>t</title></head><body><a href='/2'>t</a><footer></footer></body></html>"
    spark.createDataFrame([(i, f"https://a.example/{i}", page) for i in range(60)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    assert site_queries.audited(spark, d)["issues"].count()
    bus.waitUntilEmpty()
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(before, runs.size())]
    # what is still broadcast is asked for: the rules of structured data, and whether there is a sitemap
    broadcast = [x for x in plans if re.search(r"\) BroadcastExchange", x)]
    assert len(broadcast) <= 2
    # no plan holds all checks
    assert max(x.count(" AS check_id") for x in plans) < 20
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"


def crawled(spark, rows, listed=()):
    """rows: id, url, links; listed: url, page or None."""
    raw = [(i, u, f"<title>t{i}</title>" + "".join(f'<a href="{x}">x</a>' for x in links), 1, 1, 200, "text/html") for i, u, links in rows]
    names = spark.createDataFrame([(u, "s.xml", i) for u, i in listed], "url string, sitemap string, page_id long")
    return site.build(spark, spark.createDataFrame(raw, "id long, url string, html string, is_internal int, fetched int, status int, content_type string"), names)


T, X = "https://a.example/t", "https://a.example/x"


def test_store_that_knows_pages_by_id_holds_all_pages_of_an_url(spark):
    store = Stored(spark, new_path(spark, "store"), Config(known_by="id"))
    store.merge(crawled(spark, [(7, T, []), (5, T, []), (9, X, [])], [(T, 5), (X, None)]), batch=("crawl", 0))
    assert sorted((r.id, r.url, r.title, r.in_sitemap) for r in store.project()["pages"].collect()) == [(5, T, "t5", 1), (7, T, "t7", 0), (9, X, "t9", 1)]
    # a later crawl of one of them leaves the other; its entries and services' rows are that page's
    later = crawled(spark, [(7, T, []), (8, X, [])], [(T, 7)])
    later = later.with_tables(pages=later["pages"].withColumn("title", F.concat(F.lit("again "), "title")), api_ga4=spark.createDataFrame([(T, 1, 7), (T, 2, 5)], "url string, sessions int, page_id long"))
    assert store.merge(later, batch=("crawl", 1)) == store.merge(later, batch=("crawl", 1)) == 2
    assert sorted((r.id, r.title, r.in_sitemap) for r in store.project()["pages"].collect()) == [(5, "t5", 1), (7, "again t7", 1), (8, "again t8", 1), (9, "t9", 1)]
    assert store.project()["sitemap_urls"].count() == 3 and sorted((r.page_id, r.sessions) for r in store.project()["api_ga4"].collect()) == [(5, 2), (7, 1)]
    # what can't be told apart is refused, and so is another way of knowing pages
    page = spark.createDataFrame([(5, X), (4, X)], "id long, url string")
    for wrong in (page, spark.createDataFrame([(1, X), (1, X)], "id long, url string"), spark.createDataFrame([(None, X)], "id long, url string")):
        with pytest.raises(Exception, match="no page of its own"):
            store.merge({"pages": wrong})
    with pytest.raises(ValueError):
        Stored(spark, store.root).merge({"pages": page})
    assert store.state()["version"] == 2


def test_stored_link_leads_to_a_page_that_joins_its_url_later(spark):
    store = Stored(spark, new_path(spark, "store"), Config(known_by="id"))
    ends = lambda: sorted((r.src_id, r.dst_url[-1], r.dst_id) for r in store.project()["links"].collect())
    store.merge(crawled(spark, [(1, X, [T, T, "/n"]), (2, T, [])]))
    assert ends() == [(1, "n", None), (1, "t", 2), (1, "t", 2)]
    store.merge(crawled(spark, [(3, T, [X])]))
    # two links, each with a row for each page of the url, also after another merge
    assert ends() == [(1, "n", None), (1, "t", 2), (1, "t", 2), (1, "t", 3), (1, "t", 3), (3, "x", 1)]
    store.merge(crawled(spark, [(4, "https://a.example/n", [])]))
    assert ends() == [(1, "n", 4), (1, "t", 2), (1, "t", 2), (1, "t", 3), (1, "t", 3), (3, "x", 1)]


def test_entry_that_names_its_page_is_counted_for_that_page(spark):
    store = Stored(spark, new_path(spark, "store"), Config(known_by="id"))
    built = crawled(spark, [(1, T, []), (2, T, []), (3, X, [])], [(T, 1), (T, 2), (T, 8), (X, None), (X, 1)])
    # page 2 can't be indexed; page 8 is not there, and page 1 has another url than its entry in the last row
    store.merge(built.with_tables(pages=built["pages"].withColumn("indexable", F.expr("if(id = 2, 0, 1)"))))
    n = {r.filter: r.n for r in store.overview().where("view = 'sitemaps'").collect()}
    assert n == {None: 5, "in-sitemap": 5, "orphan": 2, "non-indexable": 1, "not-in-sitemap": 0}
    p = store.project()
    assert [views.rows(p, "sitemaps", f).count() for f in (None, "orphan", "non-indexable")] == [5, 2, 1]
    # known by url, an entry stays that of its url
    p.config = Config()
    n = {r.filter: r.n for r in views.overview(p).where("view = 'sitemaps'").collect()}
    assert n == {None: 5, "in-sitemap": 5, "orphan": 0, "non-indexable": 3, "not-in-sitemap": 0}


def test_extraction_gives_all_matches_whole(spark, monkeypatch):
    long = "y" * 3000
    doc = "<nav>" + "".join(f'<li><a href="/{i}">part {i % 10}</a>' for i in range(120)) + f'<li><a href="/{long}">z</a></nav><h1>{long}</h1>' + "<h1>h</h1>" * 70
    want = [("first", f"/{i}") for i in range(120)] + [("first", "/" + long), ("heads", long)] + [("heads", "h")] * 70 + [("marks", str(i % 10)) for i in range(120)]
    assert html.extract_all(doc, annotated_crawl.EXTRACTORS) == want
    assert html.css(doc, "h1", "html")[0] == f"<h1>{long}</h1>" and html.regex(doc, "y+") == [long, long]
    # ids tell all matches apart, more than the room of other rows, also under a store's own numbers; they are handed on in pieces
    monkeypatch.setattr(site, "GATHERED", 200_000)
    many = (1 << site.ROOM) + 5
    raw = spark.createDataFrame([(7, T, doc, 1, 1, 200, "text/html"), (8, X, "q" * many, 1, 1, 200, "text/html")], "id long, url string, html string, is_internal int, fetched int, status int, content_type string")
    p = site.extracted(site.build(spark, raw, config=Config(extractors=(*annotated_crawl.EXTRACTORS, {"id": "each", "type": "regex", "expression": "q"}))))
    store = Stored(spark, new_path(spark, "store"))
    store.merge(p)
    for t, number in ((p["extractions"], 8), (store.project()["extractions"], 2)):
        rows = [(r.extractor_id, r.value) for r in t.where(F.col("page_id") != number).orderBy("id").collect()]
        assert rows == want
        of = t.where(F.col("page_id") == number)
        assert of.agg(F.count("*"), F.count_distinct("id"), F.count_if(F.col("id") < 0)).first()[:] == (many, many, 5)
        assert of.where("id < 0").select(site.place_of("id").alias("at")).agg(F.min("at"), F.max("at")).first()[:] == (many - 5, many - 1)


def test_graph_has_all_edges(spark, monkeypatch):
    links = spark.range(1_000_500).selectExpr("id", "id div 1000 src_id", "2000 + id % 1000 dst_id", "1 is_internal")
    pages = spark.range(3000).selectExpr("id", "concat('https://a.example/', id) url", "1 is_internal", "1 fetched")
    p = Project(spark, {"pages": pages, "links": links.union(links.limit(10))})
    monkeypatch.setattr(site_queries, "crawl", lambda spark, sf_dir: p)
    assert site_queries.QUERIES["graph_edges"](spark, "").count() == 1_000_500 == graphs.edges(p, pages).count()
    assert [tuple(r) for r in graphs.edges(p, pages, 2).collect()] == [(0, 2000), (0, 2001)]
