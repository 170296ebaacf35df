"""Registered queries over the driver's tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import file_queries, site_queries
from .operators import checks, graphs, migration, redirects, segments
from .plans import exports, reports, views
from .sources import imports
from .sources.virtual_crawl import project

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PRELUDE = r"""
WITH RECURSIVE b AS (SELECT page_id AS id, regexp_replace(url, '#.*$', '') AS url, html FROM pages),
p1 AS (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1,
  CASE id % 50 WHEN 17 THEN 2 WHEN 19 THEN 3 ELSE 1 END AS fetched, CAST(id % 6 AS INT) AS depth, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS in_sitemap FROM b),
p2 AS (SELECT *, CASE WHEN fetched <> 1 THEN NULL ELSE CASE id % 20 WHEN 3 THEN 404 WHEN 7 THEN 301 WHEN 11 THEN 302 WHEN 13 THEN 500 ELSE 200 END END AS status FROM p1),
p AS (SELECT p2.*, CASE WHEN p2.status BETWEEN 300 AND 399 THEN t.url END AS redirect_target, CASE WHEN p2.status = 200 THEN 1 ELSE 0 END AS indexable,
  CAST(p2.id * 37 % 900 AS INT) AS response_ms FROM p2 LEFT JOIN b t ON t.id = p2.id + 4),
h AS (SELECT * FROM p WHERE status = 200 AND fetched = 1),
l AS (SELECT id AS src_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS dst_url FROM (SELECT id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM p)),
u AS (SELECT url, min(id) AS id FROM p GROUP BY url),
lk AS (SELECT l.*, u.id AS dst_id FROM l LEFT JOIN u ON u.url = l.dst_url),
sm AS (SELECT url FROM p WHERE id % 3 = 0 UNION ALL SELECT url || '-gone' FROM p WHERE id % 25 = 0),
ev AS (SELECT user_id AS id, count(*) AS impressions, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY user_id),
gsc AS (SELECT coalesce(p.url, 'https://orphan.example/' || ev.id) AS url, CAST(clicks AS INT) AS clicks, CAST(impressions AS INT) AS impressions FROM ev LEFT JOIN p USING (id))
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = PRELUDE + sql if sql.lstrip().upper().startswith("SELECT") else sql
        return f

    return add


def view(name: str, view_id: str, filter_id: str | None, columns: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views.rows(project(spark, sf_dir), view_id, filter_id).selectExpr(*columns.split(", "))

    run.__name__ = name
    query(sql)(run)


view("titles_duplicate", "titles", "duplicate", "id, url, title", "SELECT id, url, title FROM h WHERE title IN (SELECT title FROM h WHERE title <> '' GROUP BY title HAVING count(*) > 1)")
view("titles_under_chars", "titles", "under-chars", "id, title_chars", "SELECT id, CAST(length(title) AS INT) AS title_chars FROM h WHERE title <> '' AND length(title) < 30")
view("h1_duplicate", "h1", "duplicate", "id, h1_1", "SELECT id, h1 AS h1_1 FROM h WHERE h1 IN (SELECT h1 FROM h GROUP BY h1 HAVING count(*) > 1)")
view("view_internal", "internal", None, "id, url, status, idx, inlinks, outlinks, depth", """SELECT p.id, p.url, p.status, CASE indexable WHEN 1 THEN 'Yes' ELSE 'No' END AS idx,
  (SELECT count(*) FROM lk WHERE lk.dst_id = p.id) AS inlinks, (SELECT count(*) FROM lk WHERE lk.src_id = p.id) AS outlinks, depth FROM p""")
view("view_internal_non_indexable", "internal", "non-indexable", "id, status", "SELECT id, status FROM p WHERE indexable = 0 OR indexable IS NULL")
for _f, _k in {"success": "status BETWEEN 200 AND 299", "redirect": "status BETWEEN 300 AND 399", "client_error": "status BETWEEN 400 AND 499", "server_error": "status >= 500", "no_response": "fetched = 2", "blocked": "fetched = 3"}.items():
    view(f"response_codes_{_f}", "response_codes", _f.replace("_", "-"), "id, url, status, redirect_target", f"SELECT id, url, status, redirect_target FROM p WHERE {_k}")
view("canonicals_missing", "canonicals", "missing", "id", "SELECT id FROM h")
view("directives_blocked", "directives", "blocked", "id", "SELECT id FROM p WHERE fetched = 3")
view("sitemaps_in_sitemap", "sitemaps", "in-sitemap", "url, id, status", "SELECT sm.url, p.id, p.status FROM sm LEFT JOIN p ON p.url = sm.url")
view("sitemap_orphans", "sitemaps", "orphan", "url", "SELECT sm.url FROM sm LEFT JOIN p ON p.url = sm.url WHERE p.id IS NULL OR p.fetched = 0")
view("sitemaps_not_in_sitemap", "sitemaps", "not-in-sitemap", "id, url", "SELECT id, url FROM h WHERE in_sitemap = 0 AND indexable = 1")
view("sitemaps_non_indexable", "sitemaps", "non-indexable", "url, id", "SELECT sm.url, p.id FROM sm JOIN p ON p.url = sm.url WHERE p.indexable = 0")
view("gsc_with_data", "gsc", "with-data", "id, clicks, impressions", "SELECT p.id, clicks, impressions FROM p JOIN gsc ON gsc.url = p.url WHERE fetched = 1")
view("gsc_no_data", "gsc", "no-data", "id", "SELECT id FROM p WHERE fetched = 1 AND url NOT IN (SELECT url FROM gsc)")


@query("SELECT dst_url, count(*) AS inlinks, CAST(count(dst_id) AS BIGINT) AS resolved FROM lk GROUP BY dst_url")
def inlinks_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir)["links"].groupBy("dst_url").agg(F.count("*").alias("inlinks"), F.count("dst_id").alias("resolved"))


@query("""SELECT CAST(count(*) AS BIGINT) AS pages, CAST(count(*) AS BIGINT) AS internal, CAST(0 AS BIGINT) AS "external", CAST(sum(indexable) AS BIGINT) AS indexable FROM p WHERE fetched >= 1""")
def crawl_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(project(spark, sf_dir))


def checked(name: str, module: Callable, check_id: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return checks.run(project(spark, sf_dir), [module.__name__]).where(F.col("check_id") == check_id).select("page_id", "detail")

    run.__name__ = name
    query(sql)(run)


checked("check_broken_internal", checks.response, "response-broken-internal", "SELECT id AS page_id, status || ' — ' || (SELECT count(*) FROM lk WHERE lk.dst_id = p.id) || ' inlinks' AS detail FROM p WHERE status BETWEEN 400 AND 499")
checked("check_302", checks.response, "response-302-internal", "SELECT id AS page_id, CAST(status AS VARCHAR) AS detail FROM p WHERE status IN (302, 307)")
checked("check_not_https", checks.security, "security-not-https", "SELECT id AS page_id, CAST(NULL AS VARCHAR) AS detail FROM h WHERE url LIKE 'http:%'")
checked("check_url_params", checks.urls, "url-params", r"SELECT id AS page_id, regexp_extract(url, '(\?[^#]+)', 1) AS detail FROM h WHERE regexp_extract(url, '(\?[^#]+)', 1) <> ''")
checked("check_deep_pages", checks.site, "site-deep-pages", "SELECT id AS page_id, 'depth ' || depth AS detail FROM h WHERE depth > 3")
checked("check_sitemap_non200", checks.sitemaps, "sitemap-non200", "SELECT p.id AS page_id, 'HTTP ' || status AS detail FROM sm JOIN p ON p.url = sm.url WHERE fetched = 1 AND status <> 200")
checked("check_sitemap_missing_indexable", checks.sitemaps, "sitemap-missing-indexable", "SELECT id AS page_id, CAST(NULL AS VARCHAR) AS detail FROM h WHERE in_sitemap = 0")


@query()
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    return views.duplicated(docs, "content_hash").select(F.col("id").alias("doc_id"), "content_hash")


ORACLE_SQL["exact_duplicates"] = "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)"


@query()
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redirects.chains(project(spark, sf_dir)["pages"])
    return found.select("id", F.array_join(F.transform("chain", lambda c: F.concat_ws(" ", c["url"], c["status"].cast("string"))), " > ").alias("path"), "is_loop")


ORACLE_SQL["redirect_chains"] = PRELUDE.rstrip() + """,
w(id, here, path, seen, is_loop, done) AS (SELECT id, redirect_target, url || ' ' || status, [url], false, false FROM p WHERE redirect_target IS NOT NULL
  UNION ALL SELECT w.id, q.redirect_target, CASE WHEN list_contains(seen, here) THEN path ELSE path || ' > ' || here || ' ' || coalesce(q.status, 0) END, list_append(seen, here), list_contains(seen, here), list_contains(seen, here) OR q.redirect_target IS NULL
  FROM w LEFT JOIN p q ON q.url = w.here WHERE NOT done)
SELECT id, path, is_loop FROM w WHERE done"""


@query("""SELECT id, CASE WHEN regexp_matches(url, '(?i)\\?page=') THEN 'paged' WHEN regexp_matches(url, '(?i)utm_') THEN 'campaign' WHEN regexp_matches(url, '(?i)^https:') THEN 'secure' END AS segment FROM p""".replace("\\\\", "\\"))
def segments_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("bad", "("), ("", "x"), ("paged", r"\?page="), ("campaign", "utm_"), ("secure", "^https:")]
    return segments.assign(project(spark, sf_dir)["pages"], rules).select("id", "segment")


@query("SELECT p.id, p.url, count(lk.dst_id) AS inlinks, depth FROM p LEFT JOIN lk ON lk.dst_id = p.id WHERE fetched = 1 GROUP BY ALL ORDER BY depth, inlinks DESC, p.id LIMIT 100")
def graph_top_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.nodes(project(spark, sf_dir), 100).select("id", "url", "inlinks", "depth")


@query("SELECT h.id, h.url, count(lk.dst_id) AS inlinks, depth FROM h LEFT JOIN lk ON lk.dst_id = h.id GROUP BY ALL ORDER BY inlinks DESC, depth, h.id LIMIT 10")
def psi_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.psi_selection(project(spark, sf_dir))


@query("SELECT CAST(floor(avg(response_ms) + 0.5) AS BIGINT) AS avg_ms FROM p WHERE fetched = 1")
def average_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.average_response(project(spark, sf_dir))


@query("""SELECT bucket, n FROM (SELECT CASE WHEN fetched = 2 THEN 'no response' WHEN fetched = 3 THEN 'blocked' WHEN status < 300 THEN '2xx' WHEN status < 400 THEN '3xx' WHEN status < 500 THEN '4xx' ELSE '5xx' END AS bucket, count(*) AS n FROM p GROUP BY 1)""")
def status_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_buckets(project(spark, sf_dir))


COMPARED = """, o AS (SELECT id AS old_id, CASE WHEN id % 7 = 0 THEN url || '/old-page' WHEN id % 7 = 1 THEN regexp_replace(url, '^https?://[^/?#]*', 'https://old.example') ELSE url END AS url, status, CASE WHEN id % 3 = 0 THEN title || '!' ELSE title END AS title FROM p),
pp AS (SELECT *, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS path FROM p),
bp AS (SELECT path, arg_min(id, struct_pack(a := NOT coalesce(status BETWEEN 200 AND 299, false), b := id)) AS id FROM pp GROUP BY path),
m AS (SELECT o.*, x.id AS exact, y.id AS by_path FROM o LEFT JOIN p x ON x.url = o.url LEFT JOIN bp y ON y.path = regexp_extract(o.url, '^https?://[^/?#]*([^#]*)', 1)),
g AS (SELECT m.old_id, m.url AS old_url, m.status AS old_status, m.title AS old_title, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN by_path IS NOT NULL THEN 'path' ELSE 'none' END AS match_type, p.* FROM m LEFT JOIN p ON p.id = coalesce(exact, by_path)),
e AS (SELECT g.*, CASE WHEN g.status BETWEEN 300 AND 399 THEN coalesce(s2.redirect_target, s1.redirect_target, g.redirect_target) END AS target, CASE WHEN g.status BETWEEN 200 AND 299 THEN g.id WHEN g.status BETWEEN 300 AND 399 THEN coalesce(s3.id, s2.id, s1.id) END AS end_id
  FROM g LEFT JOIN p s1 ON g.status BETWEEN 300 AND 399 AND s1.url = g.redirect_target LEFT JOIN p s2 ON s1.status BETWEEN 300 AND 399 AND s2.url = s1.redirect_target LEFT JOIN p s3 ON s2.status BETWEEN 300 AND 399 AND s3.url = s2.redirect_target),
c AS (SELECT e.old_id, old_url, old_status, old_title, e.url AS matched_url, match_type, e.status AS new_status, f.title AS new_title, target AS redirect_target, CASE WHEN e.status BETWEEN 300 AND 399 AND f.status BETWEEN 200 AND 299 THEN 1 ELSE 0 END AS redirect_ok,
  CASE WHEN match_type = 'none' THEN 'missing' WHEN e.status BETWEEN 200 AND 299 THEN 'ok' WHEN e.status BETWEEN 300 AND 399 AND f.status BETWEEN 200 AND 299 THEN 'redirected' ELSE 'broken' END AS result,
  CASE WHEN f.id IS NOT NULL AND f.title <> old_title THEN 1 ELSE 0 END AS title_changed, 0 AS canonical_changed FROM e LEFT JOIN p f ON f.id = e.end_id)
"""


@query()
def compare_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = project(spark, sf_dir)["pages"]
    url = F.when(F.col("id") % 7 == 0, F.concat("url", F.lit("/old-page"))).when(F.col("id") % 7 == 1, F.regexp_replace("url", "^https?://[^/?#]*", "https://old.example")).otherwise(F.col("url"))
    old = pages.select(url.alias("url"), "status", F.when(F.col("id") % 3 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("title"), "canonical")
    return migration.compare(old, pages)


ORACLE_SQL["compare_sites"] = PRELUDE.rstrip() + COMPARED + "SELECT * EXCLUDE (old_id) FROM c"


@query()
def redirect_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration.suggest(compare_sites(spark, sf_dir), project(spark, sf_dir)["pages"])


WORDS = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({}), '\.(html?|php|aspx?)$', ''), '[^a-z0-9]+'), lambda t: length(t) > 1))"
OLD_PATH = "regexp_extract({}, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1)"
SLUG = "coalesce(list_extract(list_filter(string_split(regexp_extract(" + OLD_PATH + ", '^([^?]*)', 1), '/'), lambda x: x <> ''), -1), '')"
SHARE = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
ORACLE_SQL["redirect_suggestions"] = PRELUDE.rstrip() + COMPARED + f""", lost AS (SELECT old_url, result AS reason, {OLD_PATH.format("old_url")} AS old_path, {WORDS.format(SLUG.format("old_url"))} AS os, {WORDS.format("coalesce(old_title, '')")} AS ot FROM c WHERE result IN ('missing', 'broken')),
cand AS (SELECT id, url, {WORDS.format(SLUG.format("url"))} AS cs, {WORDS.format("title")} AS ct FROM h WHERE indexable = 1),
sc AS (SELECT old_url, id, url, 0.7 * {SHARE.format("os", "cs")} + 0.3 * {SHARE.format("ot", "ct")} AS score FROM lost, cand),
be AS (SELECT old_url, arg_max(url, struct_pack(a := score, b := -id)) AS target, floor(max(score) * 100 + 0.5) / 100 AS score FROM sc GROUP BY old_url)
SELECT old_url, old_path, CASE WHEN score >= 0.3 THEN target END AS target, score, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'none' END AS tier, reason FROM be JOIN lost USING (old_url)"""


@query()
def redirect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each kind of redirect file."""
    found = redirect_suggestions(spark, sf_dir)
    return views.union([exports.redirect_lines(found, k).select(F.lit(k).alias("kind"), "old_url", "value") for k in exports.REDIRECT_HEADS])


_LINE = "CASE WHEN target IS NULL THEN '# TODO no target found: ' || old_path ELSE CASE WHEN tier = 'medium' THEN '# REVIEW (medium confidence)' || chr(10) ELSE '' END || {} END"
_PATH = "regexp_extract(old_path, '^([^?]*)', 1)"
ORACLE_SQL["redirect_files"] = "SELECT k AS kind, old_url, CASE k WHEN 'htaccess' THEN {} WHEN 'nginx' THEN {} ELSE {} END AS value FROM ({}), (SELECT unnest(['htaccess', 'nginx', 'csv']) AS k) WHERE k <> 'csv' OR target IS NOT NULL".format(
    _LINE.format(f"'Redirect 301 ' || {_PATH} || ' ' || target"), _LINE.format(f"'location = ' || {_PATH} || ' {{ return 301 ' || target || '; }}'"), f"{_PATH} || ',' || target", ORACLE_SQL["redirect_suggestions"]
)


@query("""WITH r AS (SELECT '/p' || (user_id % 50) || CASE WHEN event_id % 2 = 0 THEN '/' ELSE '' END AS path, 1 AS sessions, value / 1000 AS rate FROM events)
SELECT regexp_replace(path, '/$', '') AS path, CAST(sum(sessions) AS INT) AS sessions, floor(sum(rate * sessions) / sum(sessions) * 1000 + 0.5) / 1000 AS engagement_rate FROM r GROUP BY 1""")
def ga4_weighted_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("concat('/p', user_id % 50, if(event_id % 2 = 0, '/', '')) path", "1 sessions", "1 engaged", "value / 1000 rate", "0.0 conv", "1 users")
    pages = spark.range(50).selectExpr("id", "concat('https://a.example/p', id) url", "1 is_internal", "1 fetched")
    return imports.ga4(rows, pages).select(F.regexp_replace("url", "https://a.example", "").alias("path"), "sessions", "engagement_rate")


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) / 3600 AS per_second FROM events GROUP BY 1")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.progress import urls_per_second

    got = urls_per_second(spark.read.parquet(f"{sf_dir}/events.parquet"), 3600, 3600)
    return got.select(F.col("start").alias("hour"), "n", "per_second")


@query("SELECT DISTINCT url FROM pages")
def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return imports.url_list(raw.select("url", F.concat(F.lit(" "), "url").alias("again"), F.substring("html", 1, 3).alias("no")))


@query("SELECT CASE WHEN contains(url, ',') THEN chr(34) || url || chr(34) ELSE url END || ',,' || CASE WHEN id % 2 = 0 THEN chr(39) || '=' ELSE '-' END || id AS value FROM p")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.when(F.col("id") % 2 == 0, "=").otherwise("-"), F.col("id").cast("string"))
    return exports.csv_lines(project(spark, sf_dir)["pages"].select("url", F.lit(None).cast("string").alias("empty"), cell.alias("cell")))


@query("SELECT CAST(floor((row_number() OVER (ORDER BY url) - 1) / 50) + 1 AS BIGINT) AS file, '<url><loc>' || replace(url, '&', '&amp;') || '</loc></url>' AS xml FROM h WHERE indexable = 1")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.sitemap_entries(project(spark, sf_dir)["pages"], 50).select("file", "xml")


@query("SELECT url, clicks, impressions, floor(clicks * 10000.0 / impressions + 0.5) / 100 AS ctr FROM gsc")
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = project(spark, sf_dir)["api_gsc"].withColumns({"ctr": F.col("clicks") / F.col("impressions"), "position": F.lit(1.0)})
    return imports.gsc(rows).select("url", "clicks", "impressions", "ctr")


@query("SELECT id, status FROM p WHERE status = 404")
def read_only_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark, sf_dir).sql("select id, status from PAGES where status = 404", 1000)


QUERIES |= site_queries.QUERIES | file_queries.QUERIES
ORACLE_SQL |= site_queries.ORACLE_SQL | file_queries.ORACLE_SQL
