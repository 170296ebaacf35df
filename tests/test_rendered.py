"""Two versions of a page: as it was stored and as a browser left it."""

import pytest
from auditlake import schema
from auditlake.functions import html
from auditlake.plans import views
from auditlake.project import Project
from auditlake.sources import site

HEAD = "<html><head><title>{t}</title>{h}</head><body><h1>{t}</h1><p>one two three</p>{b}</body></html>"


def test_compare_rendered():
    stored = html.parse_page(HEAD.format(t="T", h="", b='<a href="/a">a</a>'), "https://s.example/p")
    shown = html.compare_rendered(stored, HEAD.format(t="U", h='<link rel=canonical href="/c">', b='<a href="/a">a</a><a href="b" rel=nofollow>x</a><a href="b">y</a> four five'), "https://s.example/p")
    assert (shown["rendered_title"], shown["rendered_canonical"], shown["rendered_h1"], shown["rendered_word_count"], shown["rendered_meta_robots"]) == ("U", "https://s.example/c", ["U"], 5, None)
    assert [(x["href"], x["follow"]) for x in shown["render_links"]] == [("https://s.example/b", 0), ("https://s.example/b", 1)]
    assert stored["canonical_all"] is None and html.parse_page('<link rel=canonical href="/a"><link rel=canonical href="/a">', "https://s.example/")["canonical_all"] == ["https://s.example/a"] * 2


def test_build_with_rendered_pages(spark):
    same = HEAD.format(t="A title", h="", b='<a href="/2">two</a>')
    more = HEAD.format(t="A title", h="", b='<a href="/2">two</a><a href="/3">three</a><a href="/3">again</a>')
    rows = [
        (1, "https://s.example/1", same, more, 1), (2, "https://s.example/2", same, same, 1), (3, "https://s.example/3", same, more, 2), (4, "https://s.example/4", same, None, 1),
        (5, "https://s.example/5", HEAD.format(t="x", h='<link rel=canonical href="/5"><link rel=canonical href="/6">', b=""), HEAD.format(t="x", h="", b=""), 1), (6, "https://s.example/6", None, more, 1),
    ]
    raw = spark.createDataFrame([(*r, 1, 1, 200, "text/html") for r in rows], "id long, url string, html string, rendered_html string, rendered int, is_internal int, fetched int, status int, content_type string")
    p = site.build(spark, raw)
    assert sorted((r.src_id, r.dst_url, r.dst_id) for r in p["links"].where("from_render = 1").collect()) == [(1, "https://s.example/3", 3)] * 2
    assert p["links"].select("id").distinct().count() == p["links"].count() == 6
    shown = {r.id: r for r in views.rows(p, "js_rendering").collect()}
    assert shown[1].render_links == 2 and shown[2].render_links == 0 and shown[3].render_links == 0 and shown[3].word_delta is None
    ids = lambda view, f: sorted(r.id for r in views.rows(p, view, f).collect())
    assert ids("js_rendering", "rendered") == [1, 2, 4, 5, 6]
    # 1 by its links alone; 4 and 6 have no second or first version to compare
    assert set(ids("js_rendering", "changed")) >= {1, 5} and 2 not in ids("js_rendering", "changed")
    assert 5 not in ids("js_rendering", "canonical-mismatch") and shown[5].canonical_changed == "Yes"
    assert ids("canonicals", "multiple") == [5]
    assert p["html"].where("rendered_html is not null").count() == 4


def test_views_follow_the_stored_columns(spark):
    page = {"is_internal": 1, "fetched": 1, "status": 200, "content_type": "text/html"}
    pages = [{"id": 1, "url": "https://a.example/x", "title": "needle", "meta_description": "needle", "h1": ["needle"], "h2": ["needle"]}, {"id": 2, "url": "https://a.example/needle", "indexability_reason": "Noindex"}]
    names = ["id", "url", "title", "meta_description", "h1", "h2", "indexability_reason", *page]
    kinds = {f.name: f.dataType.simpleString() for f in schema.struct("pages")}
    df = spark.createDataFrame([tuple((r | page).get(n) for n in names) for r in pages], ", ".join(f"{n} {kinds[n]}" for n in names))
    psi = spark.createDataFrame([("https://a.example/x", 900.0, None), ("https://a.example/needle", 900.0, 201.0)], "url string, inp_ms double, field_inp_ms double")
    compare = spark.createDataFrame([("https://old/a", "ok", 1, None), ("https://old/b", "ok", 0, 1)], "old_url string, result string, title_changed int, canonical_changed int")
    values = spark.createDataFrame([(1, 1, "x", "needle")], "id long, page_id long, extractor_id string, value string")
    tables = {"pages": df, "api_psi": psi, "compare_results": compare, "extractions": values}
    p = Project(spark, {k: schema.ensure_columns(v, k) for k, v in tables.items()})
    for view in ("titles", "meta_descriptions", "h1", "h2"):
        assert [r.id for r in views.rows(p, view, None, "needle").collect()] == [2]
    assert views.total(p, "extraction", None, "needle") == 0 and views.total(p, "extraction", None, "/X") == 1
    assert [r.url for r in views.rows(p, "psi", "poor-inp").collect()] == ["https://a.example/needle"]
    assert [tuple(r) for r in views.query(p, "compare", "title-changed").select("url", "title_changed", "canonical_changed").collect()] == [("https://old/a", "Yes", "")]
    assert [r.canonical_changed for r in views.query(p, "compare", "canonical-changed").collect()] == ["Yes"]
    for view in ("titles", "meta_descriptions", "content"):
        assert "Noindex" in [r.indexability_reason for r in views.query(p, view).collect()]
    assert [r.title_chars for r in views.query(p, "titles").collect()] == [6, 0]


def test_ids_without_room_are_refused(spark):
    rows = spark.createDataFrame([((1 << 43) - 1, (1 << 20) - 1), (0, 0)], "page long, place long").select(site.row_id("page", "place").alias("x")).collect()
    assert [r.x for r in rows] == [(1 << 63) - 1, 0]
    for page, place in ((1 << 43, 0), (-1, 0), (1, 1 << 20)):
        with pytest.raises(Exception, match="no room"):
            spark.createDataFrame([(page, place)], "page long, place long").select(site.row_id("page", "place")).collect()
