"""Stored projects: merges, versions, streams, and the overview that is kept."""

import gzip
import time

import pytest
from auditlake import schema, stored
from auditlake.functions import robots
from auditlake.operators import robots_rules
from auditlake.plans import views
from auditlake.sources import site, sitemaps
from auditlake.store import names_in, numbered, write_once
from auditlake.streaming import ingest
from pyspark.sql import functions as F

PAGE = "<html><head><title>{t}</title></head><body><p>{t}</p>{b}</body></html>"
RAW = "id long, url string, html string, fetched int, status int, is_internal int, depth int, content_type string, error string"


def raw(spark, rows):
    """rows: id, url, title or None, links, fetched, depth."""
    return spark.createDataFrame([(i, u, None if t is None else PAGE.format(t=t, b="".join(f'<a href="{x}">x</a>' for x in links)), f, 200 if f == 1 else None, 1, d, "text/html", "gone" if f == 2 else None) for i, u, t, links, f, d in rows], RAW)


def crawl(spark, rows, listed=()):
    names = schema.ensure_columns(spark.createDataFrame([(u, "s.xml") for u in listed], "url string, sitemap string"), "sitemap_urls")
    return site.build(spark, raw(spark, rows), names)


A, B, C, D = (f"https://a.example/{x}" for x in "abcd")


def state(store):
    p = store.project()
    urls = {r.id: r.url for r in p["pages"].collect()}
    pages = sorted((r.url, r.title, r.fetched, r.depth, r.in_sitemap, r.error) for r in p["pages"].collect())
    links = sorted((urls[r.src_id], r.dst_url, urls.get(r.dst_id)) for r in p["links"].collect())
    return pages, links


def test_merge(spark, tmp_path):
    store = stored.Stored(spark, str(tmp_path / "s"))
    assert store.project()["pages"].count() == 0
    assert store.merge(crawl(spark, [(7, A, "one", [B, C], 1, 0), (9, B, None, [], 0, 1), (10, None, "no url", [], 1, 0)], [A])) == 1
    assert state(store) == ([(A, "one", 1, 0, 1, None), (B, None, 0, 1, 0, None)], [(A, B, B), (A, C, None)])
    # B is fetched and keeps its number and depth, C appears under a number that B's crawl used, A is only heard of
    before = {r.url: r.id for r in store.project()["pages"].collect()}
    assert store.merge(crawl(spark, [(1, B, "two", [A], 1, 5), (9, C, "three", [B, B], 1, 2), (3, A, None, [], 0, 9)], [A, B, A])) == 2
    pages, links = state(store)
    assert pages == [(A, "one", 1, 0, 1, None), (B, "two", 1, 1, 1, None), (C, "three", 1, 2, 0, None)]
    assert links == [(A, B, B), (A, C, C), (B, A, A), (C, B, B), (C, B, B)]
    after = {r.url: r.id for r in store.project()["pages"].collect()}
    assert all(after[u] == before[u] for u in before) and len(set(after.values())) == 3
    assert store.project()["sitemap_urls"].count() == 2
    # a failure keeps what an earlier fetch found; a new fetch replaces its links
    store.merge(crawl(spark, [(1, A, None, [], 2, 0), (2, C, "again", [D], 1, 0)]))
    pages, links = state(store)
    assert pages[0] == (A, "one", 2, 0, 1, "gone") and pages[2][1] == "again" and links == [(A, B, B), (A, C, C), (B, A, A), (C, D, None)]
    store.merge(crawl(spark, [(1, B, None, [], 3, 0)]))
    row = store.project()["pages"].where(F.col("url") == B).first()
    assert (row.fetched, row.robots_blocked, row.indexable, row.indexability_reason, row.title) == (3, 1, 0, "Blocked by robots.txt", "two")
    # one url twice in a merge: what was fetched furthest stays, with its links only
    store.merge(crawl(spark, [(1, D, "first", [A], 1, 1), (2, D, "second", [B, C], 1, 1), (3, D, None, [], 2, 1)]))
    pages, links = state(store)
    assert [p for p in pages if p[0] == D] == [(D, "second", 1, 1, 0, None)] and [x for x in links if x[0] == D] == [(D, B, B), (D, C, C)]
    assert (C, D, D) in links
    # a version that was opened stays as it was; cleared, the rest remains
    old = store.project(1)
    store.merge({"api_gsc": spark.createDataFrame([(A, 1), (B, 2)], "url string, clicks int")})
    store.merge({"api_gsc": spark.createDataFrame([(A, 5)], "url string, clicks int")})
    store.clear()
    now = store.project()
    assert now["pages"].count() == now["links"].count() == 0 and sorted((r.url, r.clicks) for r in now["api_gsc"].collect()) == [(A, 5), (B, 2)]
    assert old["pages"].count() == 2
    store.vacuum(1)
    assert names_in(spark, str(tmp_path / "s" / "pages")) == [] and store.project()["api_gsc"].count() == 2


def test_images_are_known_by_source(spark, tmp_path):
    store = stored.Stored(spark, str(tmp_path / "s"))
    kinds = "id long, src string, is_internal int, bytes long, status int, content_type string, checked int"
    store.merge({"images": spark.createDataFrame([(1, "x", 1, None, None, None, None), (2, "y", 0, 5, 200, "image/png", 1)], kinds)})
    store.merge({"images": spark.createDataFrame([(8, "x", 0, 7, 404, "image/gif", 1), (9, "y", 1, None, None, None, 0), (3, "z", 1, None, None, None, None)], kinds)})
    assert sorted(tuple(r) for r in store.project()["images"].collect()) == [(1, "x", 1, 7, 404, "image/gif", 1), (2, "y", 0, 5, 200, "image/png", 1), (3, "z", 1, None, None, None, None)]


def test_a_failed_merge_changes_nothing(spark, tmp_path, monkeypatch):
    store = stored.Stored(spark, str(tmp_path / "s"))
    store.merge(crawl(spark, [(1, A, "one", [B], 1, 0)]))
    before = state(store)
    later = crawl(spark, [(1, A, "two", [], 1, 0), (2, B, "b", [A], 1, 0)])
    write = stored.Stored._write

    def dies(self, name, df):
        if name == "image_refs":  # pages and links lie written by then
            raise RuntimeError("lost")
        return write(self, name, df)

    monkeypatch.setattr(stored.Stored, "_write", dies)
    with pytest.raises(RuntimeError):
        store.merge(later, batch=("s", 0))
    assert state(store) == before and store.state()["version"] == 1 and len(names_in(spark, str(tmp_path / "s" / "links"))) == 2
    monkeypatch.setattr(stored.Stored, "_write", write)
    assert store.merge(later, batch=("s", 0)) == 2 and store.merge(later, batch=("s", 0)) == 2
    assert [p[1] for p in state(store)[0]] == ["two", "b"] and state(store)[1] == [(B, A, A)]
    store.vacuum(1)
    assert len(names_in(spark, str(tmp_path / "s" / "links"))) == 1
    # a version is never written twice
    with pytest.raises(FileExistsError):
        write_once(spark, str(tmp_path / "s" / "_versions" / f"{2:012d}.json"), "{}")


def test_overview_is_kept(spark, tmp_path):
    store = stored.Stored(spark, str(tmp_path / "s"))
    store.merge(crawl(spark, [(1, A, "one", [B], 1, 0), (2, B, "one", [A], 1, 0)]))
    as_set = lambda df: {tuple(r) for r in df.collect()}
    first = as_set(store.overview())
    assert first == as_set(views.overview(store.project())) and len(first) == 103 and ("titles", "duplicate", 2) in first
    spark.sparkContext.setJobGroup("again", "again")
    began = time.time()
    again = store.overview()
    took = time.time() - began
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("again") == [] and took < 2
    spark.sparkContext.setJobGroup("rest", "rest")
    assert as_set(again) == first
    counted = []
    union = views.union
    try:
        views.union = lambda parts: counted.append(len(parts)) or union(parts)
        store.merge({"api_gsc": spark.createDataFrame([(A, 1), ("https://b.example/", 2)], "url string, clicks int")})
        assert ("gsc", "orphan", 1) in as_set(store.overview()) and counted == [2]
        store.merge(crawl(spark, [(1, A, "two", [B], 1, 0)]))
        assert ("titles", "duplicate", 0) in as_set(store.overview()) and as_set(store.overview()) == as_set(views.overview(store.project()))
    finally:
        views.union = union


def test_ingestion(spark, tmp_path):
    store = stored.Stored(spark, str(tmp_path / "s"))
    folder = tmp_path / "in"
    kinds = "ts timestamp, url string, html string, fetched int, status int, is_internal int, depth int, content_type string"

    def fetched(rows, name):
        df = spark.createDataFrame([(t, u, PAGE.format(t=x, b=f'<a href="{B}">b</a>')) for t, u, x in rows], "ts string, url string, html string")
        df.selectExpr("cast(ts as timestamp) ts", "url", "html", "1 fetched", "200 status", "1 is_internal", "0 depth", "'text/html' content_type").coalesce(1).write.parquet(str(folder / name))

    fetched([("2026-01-01 00:00:00", A, "old"), ("2026-01-01 00:00:05", A, "one"), ("2026-01-01 00:00:05", A, "one")], "1")

    def run():
        stream = spark.readStream.schema(kinds).option("recursiveFileLookup", "true").parquet(str(folder))
        ingest.ingest(stream, store, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()

    run()
    assert state(store)[0] == [(A, "one", 1, 0, 0, None)] and state(store)[1] == [(A, B, None)]
    kept = store.project()
    fetched([("2026-01-01 00:01:00", B, "two"), ("2026-01-01 00:01:00", A, "three")], "2")
    run()
    assert [p[1] for p in state(store)[0]] == ["three", "two"] and (A, B, B) in state(store)[1] and kept["pages"].first().title == "one"
    # the last batch once more, as after a failure: nothing changes
    version = store.state()["version"]
    number = store.state()["batches"]["pages"]
    assert ingest.add(store, spark.read.schema(kinds).parquet(str(folder / "1")), "pages", number) == version == store.state()["version"]


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "x long").repartition(5)
    assert [(r.x, r.place) for r in numbered(df, [F.col("x").asc()], "n", 3).orderBy("x").collect()] == [(i, i + 3) for i in range(50)]
    assert numbered(df.limit(0), [F.col("x").asc()], "n").count() == 0


INDEX = "<?xml version='1.0'?><sitemapindex xmlns='x'><sitemap><loc>{}</loc></sitemap><sitemap><loc> {} </loc></sitemap></sitemapindex>"
SET = "<urlset><url><loc>{}</loc><lastmod>2026-01-01</lastmod></url><url><loc>{}</loc></url></urlset>"


def test_sitemap_crawl(spark):
    r = "https://s.example/"
    files = [
        (r + "index", 200, INDEX.format(r + "one.xml", r + "packed").encode()), (r + "one.xml", 200, SET.format(r + "a&amp;b", r + "b").encode()), (r + "packed", 200, gzip.compress(SET.format(r + "b", r + "c").encode()) + gzip.compress(b"<!-- -->")),
        (r + "self", 200, INDEX.format(r + "self", r + "deep").encode()), (r + "deep", 200, INDEX.format(r + "index", r + "gone").encode()), (r + "gone", 404, None), (r + "text", 200, b"\xef\xbb\xbfhttps://s.example/x\r\nhttps://s.example/y\n# comment\n"),
        (r + "bad", 200, b"\x1f\x8bno"), (r + "empty", 200, b""), (r + "open", 200, b"<urlset><!-- "), (r + "other", 200, b"<html><url><loc>https://s.example/no</loc></url></html>"), (r + "index", 200, INDEX.format(r + "one.xml", r + "packed").encode()),
    ]
    table = spark.createDataFrame([(u, s, None if b is None else bytearray(b)) for u, s, b in files], "url string, status int, body binary")

    def read(*names, most=None):
        seeds = spark.createDataFrame([(r + n, i) for i, n in enumerate(names)], "url string, place long")
        got = sitemaps.crawl(seeds, table, most)
        return {x.url[18:]: (x.sitemap[18:], x.lastmod) for x in got.entries.collect()}, {x.sitemap[18:]: x.level for x in got.read.collect()}, {x.sitemap[18:]: x.error for x in got.errors.collect()}

    entries, level, errors = read("index")
    assert entries == {"a&b": ("one.xml", "2026-01-01"), "b": ("one.xml", None), "c": ("packed", None)} and level == {"index": 1, "one.xml": 2, "packed": 2} and not errors
    entries, level, errors = read("self", "text", "packed")
    assert entries["b"] == ("packed", "2026-01-01") and set(entries) == {"x", "y", "a&b", "b", "c"} and level == {"self": 1, "text": 1, "packed": 1, "deep": 2, "index": 3, "one.xml": 4} and errors == {"gone": "HTTP 404"}
    assert read("bad", "empty", "open", "other", "nowhere")[1:] == ({"other": 1}, {"bad": "Empty or unreadable body", "empty": "Empty or unreadable body", "open": "XML parse error", "nowhere": "Not stored"})
    # breadth first: self, text, then deep; what comes after is as if never asked for
    entries, level, errors = read("self", "gone", "text", "bad", most=3)
    assert level == {"self": 1, "text": 1, "deep": 2} and set(entries) == {"x", "y"} and errors == {"gone": "HTTP 404", "bad": "Empty or unreadable body"}
    assert read("self", "gone", "text", "bad", most=1) == ({}, {"self": 1}, {})
    assert read() == ({}, {}, {})
    listed = sitemaps.listed(spark.createDataFrame([("HTTP://S.example/x?a=1", "m", None), ("http://s.example/x?a=1", "m", "l")], "url string, sitemap string, lastmod string"))
    assert [(x.url, x.lastmod) for x in listed.collect()] == [("http://s.example/x?a=1", "l")]
    assert [x.url for x in sitemaps.listed(listed, "strip").collect()] == ["http://s.example/x"]


def test_robots_rules(spark):
    body = "User-agent: *\nDisallow: /a\nAllow: /a/b$\nDisallow: /*.pdf$\nAllow: /é\nDisallow: /%C3%A9x\nDisallow: /q?x=\n\nUser-agent: Bot/1\nUser-agent: Other\nDisallow: /bot\n"
    files = [("https://a.example", 200, body), ("http://A.example", 200, "User-agent: bot\nDisallow:\nUser-agent: *\nDisallow: /"), ("https://b.example", 404, "User-agent: *\nDisallow: /"), ("https://a.example", 200, body)]
    paths = ["/", "/a", "/a/b", "/a/bc", "/x.pdf", "/x.pdf?y", "/%C3%A9", "/%C3%A9x", "/q?x=1", "/bot", ""]
    urls = [f"{o}{p}" for o in ("https://a.example", "http://a.example", "https://b.example", "https://c.example") for p in paths] + [None, "mailto:x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, urls[1]])], "id long, url string")
    table = spark.createDataFrame(files, "origin string, status int, body string")
    for agent in ("Any", "BOT/7.1", "other"):
        got = {r.id: r.blocked for r in robots_rules.blocked(pages, table, agent).collect()}
        for i, u in enumerate(urls):
            of = next((b for o, s, b in files if s == 200 and u and (u + "/").startswith(o.lower() + "/")), None)
            path = (u or "").split("example", 1)[-1] or "/"
            assert got[i] == (0 if of is None or not u or "//" not in u else int(not robots.allowed(of, agent, path))), (agent, u)
        assert len(got) == len(urls) + 1
    assert not robots.allowed(body, "Any", "/a") and robots.allowed(body, "Any", "/a/b") and not robots.allowed(body, "Any", "/%C3%A9x") and robots.allowed(body, "bot", "/a")
