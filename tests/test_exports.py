"""Redirect suggestions against all pairs, and files written in parts."""

import json
import random
import re

from auditlake import schema
from auditlake.operators import migration
from auditlake.plans import exports
from auditlake.project import Project
from pyspark.sql import functions as F


def words(text):
    return {t for t in re.split("[^a-z0-9]+", re.sub(r"\.(html?|php|aspx?)$", "", text.lower())) if len(t) > 1}


def last(path):
    return ([x for x in path.split("?")[0].split("/") if x] or [""])[-1]


def share(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def pages(spark, rows):
    names = "id url title is_internal fetched status indexable content_type".split()
    df = spark.createDataFrame([(i, u, t, 1, 1, 200, 1, k) for i, u, t, k in rows], "id long, url string, title string, is_internal int, fetched int, status int, indexable int, content_type string")
    return schema.ensure_columns(df.select(*names), "pages")


def test_suggestions_are_those_of_all_pairs(spark, monkeypatch):
    rnd = random.Random(8)
    vocabulary = ["blog"] * 12 + ["news"] * 6 + [f"word{i}" for i in range(25)]
    name = lambda n: "-".join(rnd.choice(vocabulary) for _ in range(n))
    news = [(i, f"https://n.example/{rnd.choice(['a/', ''])}{name(rnd.randrange(1, 5))}{rnd.choice(['.html', '.PHP', '/', ''])}", name(rnd.randrange(4)).replace("-", " ") or None, "text/html") for i in range(150)]
    news += [(900, "https://n.example/word1-word2.pdf", "word1 word2", "application/pdf"), (901, "https://n.example/Été-café", "Ünï x", "text/html")]
    old = [(f"https://o.example/{name(rnd.randrange(1, 5))}{rnd.choice(['.aspx', '?q=word3', ''])}", name(rnd.randrange(3)).replace("-", " ") or None, rnd.choice(["missing", "broken"])) for _ in range(80)]
    old += [("no url at all/blog", None, "missing"), ("https://o.example", "blog", "broken"), ("https://o.example/zzz", None, "missing"), ("https://o.example/Été", "É", "missing"), ("https://o.example/ok", "blog", "ok")]
    old = list({u: (u, t, r) for u, t, r in old}.values())
    want = {}
    for u, t, r in old:
        if r == "ok":
            continue
        m = re.match(r"[a-z]+://[^/?#]+([^#]*)", u)
        path = (m[1] if m[1].startswith("/") else "/" + m[1]) if m else u
        best = max(((0.7 * share(words(last(path)), words(last(re.match(r"[a-z]+://[^/?#]+([^#]*)", v)[1]))) + 0.3 * share(words(t or ""), words(s or "")), -i, v) for i, v, s, k in news if "html" in k), default=(0, 0, None))
        score = int(best[0] * 100 + 0.5) / 100
        want[u] = (path, best[2] if score >= 0.3 else None, score, "high" if score >= 0.6 else "medium" if score >= 0.3 else "none", r)
    results = spark.createDataFrame(old, "old_url string, old_title string, result string")
    for rare in (200, 5, 0):  # all tokens rare, some, none
        monkeypatch.setattr(migration, "RARE", rare)
        got = {r.old_url: tuple(r)[1:] for r in migration.suggest(results, pages(spark, news)).collect()}
        assert got == want
    assert migration.suggest(results.limit(0), pages(spark, news)).count() == 0
    assert {r.tier for r in migration.suggest(results, pages(spark, news[:0] or [(1, "https://n/x", None, "image/png")])).collect()} == {"none"}


def read(folder, names):
    return "".join((folder / n).read_bytes().decode() for n in names)


def test_redirect_files(spark, tmp_path):
    rows = [("https://o/a?x=1", "/a?x=1", "https://n/a", 0.9, "high", "missing"), ("https://o/b", "/b", "https://n/b,c", 0.4, "medium", "broken"), ("https://o/c?y", "/c?y", None, 0.1, "none", "missing")]
    found = spark.createDataFrame(rows, "old_url string, old_path string, target string, score double, tier string, reason string").repartition(3)
    texts = {k: read(tmp_path / k, exports.redirect_file(found, k, str(tmp_path / k))) for k in exports.REDIRECT_HEADS}
    assert texts["htaccess"].split("\n")[2:] == ["", "Redirect 301 /a https://n/a", "# REVIEW (medium confidence)", "Redirect 301 /b https://n/b,c", "# TODO no target found: /c?y", ""]
    assert texts["nginx"].split("\n")[1:] == ["", "location = /a { return 301 https://n/a; }", "# REVIEW (medium confidence)", "location = /b { return 301 https://n/b,c; }", "# TODO no target found: /c?y", ""]
    assert texts["csv"] == 'source,target\n/a,https://n/a\n/b,"https://n/b,c"\n'


def test_ordered_parts(spark, tmp_path):
    lines = spark.range(1000).select((F.col("id") * 7 % 1000).alias("n")).withColumn("value", F.concat(F.lit("line "), "n")).repartition(8)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = exports.ordered_text(lines, ["n"], str(tmp_path / "t"), "head")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(parts) > 1 and read(tmp_path / "t", parts) == "head\n" + "".join(f"line {i}\n" for i in range(1000))
    assert json.loads((tmp_path / "t" / "_manifest.json").read_text()) == {"parts": parts}
    assert read(tmp_path / "e", exports.ordered_text(lines.limit(0), ["n"], str(tmp_path / "e"), "head")) == "head\n"


def test_files_of_a_project(spark, tmp_path):
    rows = [(i, f"https://a/{i:03d}", "t", "text/html") for i in range(25)]
    images = schema.ensure_columns(spark.createDataFrame([(7, "https://a/i&.png", 1)], "id long, src string, is_internal int"), "images")
    refs = schema.ensure_columns(spark.createDataFrame([(i, i, 7) for i in range(5)], "id long, page_id long, image_id long"), "image_refs")
    p = Project(spark, {"pages": pages(spark, rows), "images": images, "image_refs": refs})
    names = exports.sitemap_files(p, "https://a/", str(tmp_path / "s"), 4)
    assert names == [*[f"sitemap-{i}.xml" for i in range(1, 8)], "sitemap.xml", "image-sitemap-1.xml", "image-sitemap-2.xml", "image-sitemap.xml"] and sorted(x.name for x in (tmp_path / "s").iterdir() if not x.name.startswith(".")) == sorted(names)
    locs = [u for i in range(1, 8) for u in re.findall("<loc>(.*?)</loc>", (tmp_path / "s" / f"sitemap-{i}.xml").read_text())]
    assert locs == [u for _, u, _, _ in rows] and re.findall("<loc>(.*?)</loc>", (tmp_path / "s" / "sitemap.xml").read_text()) == [f"https://a/sitemap-{i}.xml" for i in range(1, 8)]
    text = (tmp_path / "s" / "image-sitemap-2.xml").read_text()
    assert text.startswith('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns=') and "https://a/i&amp;.png" in text and text.endswith("</urlset>\n") and text.count("<url>") == 1
    few = Project(spark, {"pages": pages(spark, rows[:2])})
    assert exports.sitemap_files(few, "https://a", str(tmp_path / "f")) == ["sitemap.xml"] and (tmp_path / "f" / "sitemap.xml").read_text().count("<url>") == 2
    issues = schema.ensure_columns(spark.createDataFrame([("title-missing", 1, None)], "check_id string, page_id long, detail string"), "issues")
    found = exports.csv_folder(few, issues, str(tmp_path / "c"))
    assert found[0] == "issues-summary.csv" and "titles.csv" in found
    assert read(tmp_path / "c" / "issues-summary.csv", json.loads((tmp_path / "c" / "issues-summary.csv" / "_manifest.json").read_text())["parts"]).split("\r\n")[1].startswith("title-missing,")
