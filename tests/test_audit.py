"""Checks, views and algorithms on small hand-made projects."""

from auditlake import schema
from auditlake.functions import html, robots, text, url
from auditlake.operators import checks, graphs, migration, near_duplicates, redirects, segments
from auditlake.plans import exports, reports, views
from auditlake.project import Project
from auditlake.sources import imports
from pyspark.sql import functions as F


def pages(spark, rows):
    names = sorted({k for r in rows for k in r})
    fields = {f.name: f.dataType.simpleString() for f in schema.struct("pages")}
    base = {"is_internal": 1, "fetched": 1, "status": 200, "content_type": "text/html", "title_count": 1, "indexable": 1}
    rows = [base | {"id": i + 1} | r for i, r in enumerate(rows)]
    names = sorted({k for r in rows for k in r})
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {fields[n]}" for n in names))
    return schema.ensure_columns(df, "pages")


def table(spark, name, rows):
    fields = {f.name: f.dataType.simpleString() for f in schema.struct(name)}
    names = list(rows[0])
    return schema.ensure_columns(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {fields[n]}" for n in names)), name)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.check_id, []).append(r.page_id)
    return out


def test_all_checks(spark):
    t = "A title that is long enough for the check"
    p = Project(spark, {"pages": pages(spark, [
        {"url": "https://a.example/", "title": t, "depth": 0, "word_count": 500},
        {"url": "http://a.example/b", "title": "B", "depth": 5, "word_count": 50, "meta_robots": "noindex", "indexable": 0},
        {"url": "https://a.example/Some_Page?x=1", "title": t, "depth": 1, "word_count": 500, "viewport": "w"},
        {"url": "https://a.example/d", "title": None, "depth": 1, "word_count": 50, "viewport": "w", "meta_description": "short"},
    ])})
    got = found(checks.run(p))
    assert sorted(got["title-duplicate"]) == [1, 3] and got["title-missing"] == [4] and got["directives-noindex"] == [2]
    assert got["content-thin"] == [4] and got["security-not-https"] == [2] and got["url-uppercase"] == got["url-underscores"] == got["url-params"] == [3]
    assert sorted(got["mobile-viewport-missing"]) == [1, 2] and got["site-deep-pages"] == [2] and sorted(got["desc-missing"]) == [1, 3]
    assert set(got) <= set(checks.REGISTRY) and len(checks.REGISTRY) == 85


def test_sitemaps_hreflang_structured(spark):
    p = Project(spark, {
        "pages": pages(spark, [
            {"url": "https://a/ok", "in_sitemap": 1}, {"url": "https://a/no", "in_sitemap": 1, "indexable": 0, "indexability_reason": "Noindex"},
            {"url": "https://a/canon", "in_sitemap": 1, "canonical": "https://a/ok"}, {"url": "https://a/404", "in_sitemap": 1, "status": 404}, {"url": "https://a/miss", "in_sitemap": 0},
        ]),
        "sitemap_urls": table(spark, "sitemap_urls", [{"url": f"https://a/{x}"} for x in ("ok", "no", "canon", "404", "gone")]),
        "hreflang": table(spark, "hreflang", [{"id": 1, "page_id": 1, "lang": "fr_FR", "href": "https://a/404"}, {"id": 2, "page_id": 1, "lang": "en", "href": "https://a/ok"}, {"id": 3, "page_id": 1, "lang": "fr", "href": "https://a/miss"}, {"id": 4, "page_id": 5, "lang": "fr", "href": "https://a/miss"}]),
        "structured_data": table(spark, "structured_data", [
            {"id": 1, "page_id": 1, "format": "jsonld", "type": "Product", "json": '{"@type":"Product"}'}, {"id": 2, "page_id": 2, "format": "jsonld", "type": "Recipe", "json": '{"name":"x"}'},
            {"id": 3, "page_id": 3, "format": "jsonld", "type": "FAQPage", "json": '{"mainEntity":[]}'}, {"id": 4, "page_id": 4, "format": "jsonld", "type": "PARSE_ERROR", "json": "{"},
        ]),
    })
    got = found(checks.run(p))
    assert got["sitemap-non200"] == [4] and got["sitemap-noindex"] == [2] and got["sitemap-canonicalised"] == [3] and got["sitemap-orphan"] == [None] and got["sitemap-missing-indexable"] == [5]
    assert got["hreflang-invalid-code"] == [1] and got["hreflang-missing-return"] == [1] and got["hreflang-to-broken"] == [1]
    assert sorted(got["sd-missing-required"]) == [1, 2] and got["sd-deprecated-type"] == [3] and got["sd-parse-error"] == [4]
    assert not found(checks.run(Project(spark, {"pages": p["pages"]}))).get("sitemap-missing-indexable")


def test_every_view_and_filter(spark):
    p = Project(spark, {"pages": pages(spark, [{"url": "https://a/x", "title": "t"}, {"url": "https://a/y", "title": "t", "indexable": None}])})
    for name, v in views.VIEWS.items():
        whole = views.total(p, name)
        for f in v.filters:
            rows = views.query(p, name, f)
            assert tuple(rows.columns) == v.columns
            assert name in ("sitemaps", "gsc") or rows.count() <= whole
        assert views.total(p, name, "unknown") == whole
    assert views.query(p, "visualization") is None and views.total(p, "titles", "duplicate") == 2
    assert views.total(p, "internal", "non-indexable") == 1 and views.total(p, "internal", None, " X ") == 1
    assert len(views.VIEWS) == 23 and sum(len(v.filters) for v in views.VIEWS.values()) == 80


def test_details_of_checks(spark):
    p = Project(spark, {
        "pages": pages(spark, [
            {"url": "https://a/1", "text_ratio": 0.05, "word_count": 9, "rel_next": "https://a/2", "rel_prev": "", "canonical_all": ["x", "y", "x"]}, {"url": "https://a/2", "status": 404, "rel_prev": "https://a/1"},
            {"url": "https://a/3", "text_ratio": 0.0514, "word_count": 9, "rel_prev": "https://a/9", "canonical": "https://a/1", "rendered": 1, "rendered_word_count": 400},
        ]),
        "meta": table(spark, "meta", [{"key": "robots_txt", "value": "User-agent: CCBot\nDisallow: /"}]),
        "images": table(spark, "images", [{"id": 1, "src": "https://a/i", "status": 404, "bytes": 204801}]), "image_refs": table(spark, "image_refs", [{"id": i, "page_id": 1, "image_id": 1} for i in (1, 2)]),
        "hreflang": table(spark, "hreflang", [{"id": 1, "page_id": 1, "lang": "x-default", "href": "https://a/2"}]),
        "structured_data": table(spark, "structured_data", [{"id": 1, "page_id": 1, "format": "jsonld", "type": "Thing, HowTo,FAQPage", "json": '{"name":1}'}, {"id": 2, "page_id": 1, "format": "microdata", "type": "Product", "json": '{"properties":{"name":[]}}'}]),
    })
    got = {(r.check_id, r.page_id): r.detail for r in checks.run(p).collect()}
    assert got["content-low-text-ratio", 1] == "5% text" and got["content-low-text-ratio", 3] == "5.1% text" and got["canonical-multiple-conflicting", 1] == "x | y | x"
    assert got["pagination-to-non200", 1] == "rel=next → https://a/2 (404)" and got["pagination-canonicalised", 3] == "canonical → https://a/1" and got["render-content-delta", 3] == "9 raw vs 400 rendered words"
    assert got["img-broken", 1] == "1: https://a/i" and got["img-over-warn", 1] == "1 images over 200KB" and got["hreflang-to-broken", 1] == "https://a/2 (HTTP 404)" and ("site-ai-crawlers", None) not in got
    assert got["sd-deprecated-type", 1] == "HowTo" and got["sd-missing-required", 1] == "howto: step"
    assert [(r.errors, len(r.warnings)) for r in checks.with_findings(p).orderBy("id").collect()] == [(["Missing required property: step"], 0), ([], 7)]


def test_html_and_urls():
    doc = """<title> A &amp;  b</title><meta name="Description" content="d1"><link rel=canonical href="/x?a=1#f"><link rel=alternate hreflang=fr href="fr/"><meta name=robots content="NOINDEX, follow">
    <script type="application/ld+json">{"@graph":[{"@type":["A","B"]}]}</script><script type="application/ld+json">{bad</script><base href="http://h.example/base/"></head><body><p>one<p>two<ul><li>a<li>b</ul>
    <div itemscope itemtype="http://schema.org/Product"><span itemprop=name>N</span><div itemscope itemprop=offer><i itemprop=price content=5></i></div></div><img src=i.png alt=""><img data-src="j.png" width=1 height=2>
    <svg><title>no</title><path/></svg><a href="mailto:x">m</a><a href="../up" rel="NoFollow" class="c d">t <b>u</b></a><table><tr><td>1<td>2</table>"""
    r = html.parse_page(doc, "http://www.Host.example:80/dir/p.html")
    assert (r["title"], r["title_count"], r["meta_description"], r["meta_robots"], r["canonical"]) == ("A & b", 1, "d1", "noindex, follow", "http://h.example/x?a=1")
    assert r["links"] == [{"href": "http://h.example/up", "anchor": "t u", "rel": "nofollow", "follow": 0}] and r["hreflang"] == [{"lang": "fr", "href": "http://h.example/base/fr/"}]
    assert [(i["src"], i["alt"], i["has_dimensions"]) for i in r["images"]] == [("http://h.example/base/i.png", "", 0), ("http://h.example/base/j.png", None, 1)]
    assert [x["type"] for x in r["structured"]] == ["A,B", "PARSE_ERROR", "Product"] and '"price":["5"]' in r["structured"][2]["json"] and r["word_count"] == 4
    assert html.css(doc, "ul > li") == ["a", "b"] == html.xpath(doc, "//li") and html.css(doc, 'a.c[href^=".."]', "attr", "href") == ["../up"] and html.css(doc, "p + p, td:last-child") == ["two", "2"]
    assert html.xpath(doc, "count(//td)") == ["2"] and html.regex(doc, r"<LI>(\w)") == ["a", "b"] and html.extract_all(doc, [{"id": "bad", "type": "css", "expression": "a["}, {"id": "re", "type": "regex", "expression": "("}]) == []
    assert html.parse_page("", "http://a/")["word_count"] == 0 and html.spa_of('<div id="__next">') == "Next.js (React)"
    cases = {("a b", "http://h/x/y?q"): "http://h/x/a%20b", ("//O.x:443/p/../q", "https://h/"): "https://o.x/q", ("?z=é", "http://h/a#b"): "http://h/a?z=%C3%A9", ("HTTP://Ex.com:80", None): "http://ex.com/", ("http://0x7f.1/", None): "http://127.0.0.1/"}
    cases |= {("javascript:1", "http://h/"): None, ("http://a b/", None): None, ("x", None): None, ("", "http://h/a?b"): "http://h/a?b", ("http://h:99999/", None): None, ("http://h/%7e/./%2E%2e/z", None): "http://h/z", ("https:foo", "https://h/a/b"): "https://h/a/foo"}
    assert {k: url.normalize(*k) for k in cases} == cases
    assert url.apply_params("http://h/?a=1&b=2", "list", ["b"]) == "http://h/?a=1" and url.apply_params("http://h/?a=1", "strip") == "http://h/" and url.apply_params("http://h/?a=1") == "http://h/?a=1"


def test_url_columns(spark):
    df = spark.createDataFrame([("https://www.a.example/x.PDF?y",), ("http://b.a.example/p.png",), ("https://aa.example/",)], "u string")
    u = F.col("u")
    rows = df.select(url.is_internal(u, "a.example").alias("a"), url.is_internal(u, "a.example", True).alias("b"), url.looks_binary(u).alias("c"), url.looks_image(u).alias("d"), url.in_scope(u, ["X", "("], ["png"], lambda p: segments.usable(spark, p)).alias("e"), url.status_text(F.lit(404)).alias("f"), url.link_canonical(F.lit('<http://c/>; rel="canonical"')).alias("g"), url.days_ago(1).alias("h")).collect()
    assert [tuple(r)[:5] for r in rows] == [(True, True, True, False, True), (False, True, False, True, False), (False, False, False, False, True)]
    assert rows[0].f == "Not Found" and rows[0].g == "http://c/" and len(rows[0].h) == 10


def test_redirects(spark):
    rows = [{"url": u, "status": s, "redirect_target": t} for u, s, t in (("a", 301, "b"), ("b", 302, "c"), ("c", 200, None), ("l", 301, "m"), ("m", 301, "l"), ("s", 301, "s"), ("u", 301, "never"))]
    got = {r.url: ([c.url for c in r.chain], r.is_loop) for r in redirects.chains(pages(spark, rows)).collect()}
    assert got["a"] == (["a", "b", "c"], False) and got["l"] == (["l", "m"], True) and got["s"] == (["s"], True) and got["u"] == (["u", "never"], False)


def test_long_redirects(spark):
    chain = [(f"c{i}", 301, f"c{i + 1}") for i in range(60)] + [("c60", 200, None)]
    loop = [(f"l{i}", 302, f"l{(i + 1) % 4}") for i in range(4)] + [("into", 301, "l2")]
    rows = [{"url": u, "status": s, "redirect_target": t} for u, s, t in chain + loop]
    got = {r.url: ([c.url for c in r.chain], r.is_loop) for r in redirects.chains(pages(spark, rows)).collect()}
    want = {f"c{i}": ([f"c{j}" for j in range(i, 61)], False) for i in range(60)} | {f"l{i}": ([f"l{(i + j) % 4}" for j in range(4)], True) for i in range(4)} | {"into": (["into", "l2", "l3", "l0", "l1"], True)}
    assert got == want


def test_migration(spark):
    old = spark.createDataFrame([("https://o/a", 200, "A", None), ("https://o/b", 200, "B", None), ("https://o/r", 200, "R", None), ("https://o/living-annuity", 200, "Living annuity", None)], "url string, status int, title string, canonical string")
    new = pages(spark, [{"url": "https://n/a", "title": "A"}, {"url": "https://n/b/", "title": "other"}, {"url": "https://n/r", "status": 301, "redirect_target": "https://n/dead"}, {"url": "https://n/living-annuity-guide", "title": "Living annuity guide"}])
    got = {r.old_url[-1]: r for r in migration.compare(old, new).collect()}
    assert (got["a"].match_type, got["a"].result) == ("path", "ok") and (got["b"].match_type, got["b"].title_changed) == ("path", 1)
    assert got["r"].result == "broken" and got["y"].result == "missing" and got["y"].title_changed == 0 and got["r"].redirect_target == "https://n/dead"
    err = pages(spark, [{"url": "https://n/a", "status": None, "fetched": 2}, {"url": "https://n/b", "status": 302, "redirect_target": "https://n/c"}, {"url": "https://n/c", "status": 301, "redirect_target": "https://n/d"}, {"url": "https://n/d", "title": "D"}, {"url": "https://n/r", "status": 301, "redirect_target": "https://n/r"}])
    more = {r.old_url[-1]: r for r in migration.compare(old, err).collect()}
    assert (more["a"].result, more["a"].match_type) == ("broken", "path") and (more["b"].result, more["b"].new_title, more["b"].redirect_target, more["b"].title_changed) == ("redirected", "D", "https://n/d", 1) and (more["r"].result, more["r"].new_title) == ("broken", None)
    best = {r.old_url: r for r in migration.suggest(migration.compare(old, new), new).collect()}
    assert best["https://o/living-annuity"].target == "https://n/living-annuity-guide" and best["https://o/r"].target is None


def test_graph_segments_and_robots(spark):
    ps = pages(spark, [{"url": "r", "depth": 0}, {"url": "x", "depth": 1, "crawl_source": "r"}, {"url": "e", "is_internal": 0}])
    links = table(spark, "links", [{"id": 1, "src_id": 1, "dst_url": "x", "dst_id": 2, "is_internal": 1}, {"id": 2, "src_id": 1, "dst_url": "x", "dst_id": 2, "is_internal": 1}, {"id": 3, "src_id": 2, "dst_url": "x", "dst_id": 2, "is_internal": 1}])
    p = Project(spark, {"pages": ps, "links": links})
    nodes = graphs.nodes(p)
    assert [r.id for r in nodes.collect()] == [1, 2] and [tuple(r) for r in graphs.edges(p, nodes).collect()] == [(1, 2)]
    assert {r.id: r.parent_id for r in graphs.tree(ps.where("is_internal = 1")).collect()} == {1: None, 2: 1}
    ring = pages(spark, [{"url": "a", "crawl_source": "b"}, {"url": "b", "crawl_source": "a"}, {"url": "c", "crawl_source": "a"}])
    assert {r.id: r.parent_id for r in graphs.tree(ring).collect()} == {1: None, 2: None, 3: None}
    line = pages(spark, [{"url": f"n{i}", "crawl_source": f"n{i - 1}"} for i in range(20)])
    assert {r.id: r.parent_id for r in graphs.tree(line).collect()} == {1: None} | {i: i - 1 for i in range(2, 21)}
    got = {r.url: r.segment for r in segments.assign(ps, [("bad", "("), ("first", "^x"), ("second", ".")]).collect()}
    assert got == {"r": "second", "x": "first", "e": None}
    txt = "User-agent: *\nAllow: /\nUser-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /\n"
    assert [b for b in checks.AI_CRAWLERS if not robots.allowed(txt, b, "/")] == ["GPTBot", "ClaudeBot"]
    reach = graphs.frontier(spark.createDataFrame([("r",)], "url string"), spark.createDataFrame([("r", "x"), ("x", "y"), ("y", "r")], "src_url string, dst_url string"), 5)
    assert {r.url: r.depth for r in reach.collect()} == {"r": 0, "x": 1, "y": 2}
    hops = spark.createDataFrame([("r", "s", 1, 1, 0), ("r", "e", 1, 0, 0), ("e", "z", 1, 1, 0), ("r", "n", 0, 1, 0), ("s", "t", 1, 1, 1)], "src_url string, dst_url string, follow int, is_internal int, is_redirect int")
    seed = spark.createDataFrame([("r",)], "url string")
    assert {r.url: r.depth for r in graphs.frontier(seed, hops, 5, None, False).collect()} == {"r": 0, "s": 1, "e": 1, "t": 1}
    assert [r.url for r in graphs.frontier(seed, hops, 5, 2).collect()] == ["r", "e"]


def fnv(s):
    h = 0xCBF29CE484222325
    raw = s.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 0x100000001B3 % (1 << 64)
    return h


def simhash(s):
    w = s.lower().split()
    shingles = [] if not w else [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    votes = [sum(1 if fnv(x) >> i & 1 else -1 for x in shingles) for i in range(64)]
    return sum(1 << i for i in range(64) if votes[i] > 0)


def test_text_functions(spark):
    cases = ["", "one", "two words", "hello world foo", "a b c d e f g", "\U0001f600 x y z"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    rows = df.select("t", text.fnv64(F.col("t")).alias("f"), text.simhash(F.col("t")).alias("s"), text.pixels(F.col("t"), 20).alias("p"), text.clean_text(F.lit("  a  b ")).alias("c")).collect()
    for r in rows:
        assert (r.f.hi << 32 | r.f.lo) == fnv(r.t) and r.s % (1 << 64) == simhash(r.t) and r.c == "a b"
    assert fnv("hello world foo") == 0x371CF01BFF3B2C77 and rows[1].p == round((556 + 556 + 556) * 20 / 1000)


def test_near_duplicates(spark):
    base = 0x1234567890ABCDEF
    flip = {1: 0, 2: 0b111, 3: 0b1111 << 16, 4: 0b1111111 << 32, 5: 0}
    rows = spark.createDataFrame([(i, f"u{i}", base ^ m, "same" if i == 5 else "same" if i == 1 else f"h{i}") for i, m in flip.items()], "id long, url string, simhash long, content_hash string")
    got = {(r.a, r.b) for r in near_duplicates.pairs(rows, 0.9).collect()}
    assert (1, 2) in got and (1, 3) in got and (1, 4) not in got and (1, 5) not in got
    assert {r.page_id: r.partner_id for r in near_duplicates.first_matches(rows).collect()}[1] == 3  # they share band 0, which comes first


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    base, rows = 0x1234567890ABCDEF, []
    for i in range(300):
        flips = sum(1 << b for b in rnd.sample(range(63), rnd.randrange(9)))
        rows.append((i, f"u{i}", base ^ flips if i % 3 else base, rnd.choice(["same", None, f"h{i}"])))
    frame = spark.createDataFrame(rows, "id long, url string, simhash long, content_hash string")
    want, first = {}, {}
    for i, _, s, _ in rows:
        for k in range(4):
            v = (k, s >> 16 * k & 65535)
            first[v] = min(first.get(v, i), i)
    pairs = set()
    for i, _, s, h in rows:
        for j, _, t, g in rows:
            n = (s ^ t).bit_count()
            for k in range(4):
                v = (k, s >> 16 * k & 65535)
                if i != j and h != g and n <= 6 and t >> 16 * k & 65535 == v[1]:
                    pairs.add((k, min(i, j), max(i, j)))
                    want[i] = min(want.get(i, (9**9,)), (first[v], k, min(i, j), max(i, j), j, int((1 - n / 64) * 100 + 0.5)))
    for bucket in (2000, 20):
        monkeypatch.setattr(near_duplicates, "BUCKET", bucket)
        assert {r.page_id: (r.partner_id, r.similarity) for r in near_duplicates.first_matches(frame).collect()} == {i: w[4:] for i, w in want.items()}
        assert sorted((r.band, r.a, r.b) for r in near_duplicates.pairs(frame, 0.9).collect()) == sorted(pairs)


def test_imports_exports(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes('﻿Target URL,Domain Rating,Referring domains\r\n"https://a/x","1,234",5\r\n,,\r\nhttps://a/x,7,8\r\n'.encode())
    got = imports.backlinks(imports.read_csv(spark, str(tmp_path / "b.csv")), "any").collect()
    assert [(r.url, r.domain_rating, r.ref_domains) for r in got] == [("https://a/x", 7.0, 8)]
    files = spark.createDataFrame([("s.xml", "<urlset><url><loc>https://a/1&amp;2</loc><lastmod>2026-01-01</lastmod></url></urlset>"), ("s.txt", "https://a/3\nno\nhttps://a/3")], "sitemap string, body string")
    assert sorted((r.url, r.lastmod) for r in imports.sitemap_rows(files).collect()) == [("https://a/1&2", "2026-01-01"), ("https://a/3", None)]
    cells = spark.createDataFrame([("=1", "-42", "-2+3", 'a"b', "x,y", None)], "a string, b string, c string, d string, e string, f string")
    assert exports.csv_lines(cells).first().value == "'=1,-42,'-2+3,\"a\"\"b\",\"x,y\","
    ps = pages(spark, [{"url": "https://a/1&2"}, {"url": "https://a/2", "canonical": "https://a/1"}, {"url": "https://a/3", "indexable": 0}])
    assert [r.xml for r in exports.sitemap_entries(ps).collect()] == ["<url><loc>https://a/1&amp;2</loc></url>"]
    assert imports.provider_of(["URL", "Trust Flow"]) == "majestic" and imports.provider_of(["Target URL", "DR"]) == "ahrefs" and imports.provider_of(["url"]) == "generic"
    p = Project(spark, {"pages": pages(spark, [{"url": f"https://a/{i}", "title": "x,y"} for i in range(3)]), "images": table(spark, "images", [{"id": 7, "src": "https://a/i.png", "is_internal": 1}]), "image_refs": table(spark, "image_refs", [{"id": 1, "page_id": 2, "image_id": 7}])})
    assert exports.sitemap_files(p, "https://a/", str(tmp_path / "s"), 2) == ["sitemap-1.xml", "sitemap-2.xml", "sitemap.xml", "image-sitemap.xml"]
    assert "<loc>https://a/sitemap-2.xml</loc>" in (tmp_path / "s" / "sitemap.xml").read_text() and "<loc>https://a/2</loc>" in (tmp_path / "s" / "sitemap-2.xml").read_text()
    parts = exports.csv_file(p, "titles", str(tmp_path / "t.csv"))
    lines = "".join((tmp_path / "t.csv" / n).read_bytes().decode() for n in parts).removesuffix("\r\n").split("\r\n")
    assert lines[0] == "\ufeffUrl,Title,Title Chars,Title Px,Title Count,Idx,Indexability Reason" and lines[1] == 'https://a/0,"x,y",3,,1,Yes,' and len(lines) == 4


def test_project_and_reports(spark, tmp_path):
    p = Project(spark, {"pages": pages(spark, [{"url": "https://a/x", "response_ms": 3}, {"url": "https://a/y", "status": 404, "response_ms": 4, "indexable": 0}])})
    p.save(str(tmp_path / "p"))
    q = Project.open(spark, str(tmp_path / "p"))
    assert q.sql("select count(*) n from PAGES").first().n == 2 and q["meta"].first().value == "4" and Project.valid(spark, str(tmp_path / "p")) and not Project.valid(spark, str(tmp_path / "none"))
    for bad in ("drop table pages", "select 1; select 2"):
        try:
            q.sql(bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    issues = checks.run(q)
    assert reports.average_response(q).first().avg_ms == 4 and {r.bucket: r.n for r in reports.status_buckets(q).collect()} == {"2xx": 1, "4xx": 1}
    assert all(0 <= r.score <= 100 for r in reports.category_health(q, issues).collect())
    assert reports.worst_pages(q, issues).count() == 2 and views.overview(q).count() == 103
