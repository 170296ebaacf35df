"""Queries over the annotated crawl, each with the same in SQL, which knows the annotations and not the parser."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import url
from .functions.text import DESC_PX, OTHER_WIDTH, TITLE_PX, WIDTHS
from .operators import checks, detail, graphs, near_duplicates
from .plans import reports, views
from .project import Project
from .sources.annotated_crawl import MARKS, RENDER_MARKS, project
from .store import joined_by_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def px(column: str, font: int) -> str:
    return f"CAST(floor(list_sum(list_transform(string_split({column}, ''), lambda c: CASE WHEN ord(c) BETWEEN 32 AND 126 THEN {WIDTHS}[ord(c) - 31] ELSE {OTHER_WIDTH} END)) * {font} / 1000.0 + 0.5) AS INT)"


ENTITIES = "replace(replace(replace(replace({}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"
TEXTS = r"regexp_replace(regexp_replace({}, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
H = "is_internal = 1 AND fetched = 1 AND status = 200"
PRELUDE = (
    r"""
WITH RECURSIVE b AS (SELECT page_id AS id, regexp_replace(url, '#.*$', '') AS url, html, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM pages),
n AS (SELECT b.*, x.url AS t1, y.url AS t4, z.url AS p1 FROM b LEFT JOIN b x ON x.id = b.id + 1 LEFT JOIN b y ON y.id = b.id + 4 LEFT JOIN b z ON z.id = b.id - 1),
m0 AS (SELECT *, """
    + ", ".join(f"{v} AS {k}" for k, v in MARKS.items())
    + """ FROM n),
m AS (SELECT *, """
    + ", ".join(f"{v} AS {k}" for k, v in RENDER_MARKS.items())
    + r""", CASE id % 50 WHEN 17 THEN 2 WHEN 19 THEN 3 ELSE 1 END AS fetched, CASE WHEN id % 33 = 32 THEN 0 ELSE 1 END AS is_internal, CAST(id % 6 AS INT) AS depth FROM m0),
s AS (SELECT *, CASE WHEN fetched <> 1 THEN NULL ELSE CASE id % 20 WHEN 3 THEN 404 WHEN 7 THEN 301 WHEN 11 THEN 302 WHEN 13 THEN 500 ELSE 200 END END AS status,
  CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS in_sitemap, CASE WHEN fetched = 1 THEN robots END AS meta_robots, x_robots_at AS x_robots, CASE WHEN fetched = 1 THEN canonical_1 END AS canonical,
  CASE WHEN fetched = 1 THEN """ + "trim(" + ENTITIES.format("regexp_extract(html, '<title>([^<]*)</title>', 1)") + r""") END AS title,
  CASE WHEN fetched = 1 THEN """ + "trim(" + ENTITIES.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)") + r""") END AS h1_1,
  regexp_replace(""" + ENTITIES.format(TEXTS.format(r"replace(regexp_replace(html, '(?s)^.*?<body[^>]*>', ''), '<footer>', coalesce(' ' || h1_2, '') || coalesce(h2_1, '') || CASE WHEN link_1 IS NULL THEN '' ELSE 'next one' END || CASE WHEN link_2 IS NULL THEN '' ELSE 'out' END)")) + r""", '\s+', ' ', 'g') AS body FROM m),
q AS (SELECT *, trim(body) AS visible, CASE WHEN fetched = 1 THEN CAST(len(string_split(trim(body), ' ')) AS INT) END AS word_count,
  CASE WHEN status BETWEEN 300 AND 399 THEN CASE WHEN id % 40 IN (7, 27) THEN t4 WHEN id % 40 = 11 THEN url ELSE p1 END END AS redirect_target,
  CASE WHEN fetched = 3 THEN 'Blocked by robots.txt' WHEN status BETWEEN 300 AND 399 THEN 'Redirect' WHEN status BETWEEN 400 AND 499 THEN 'Client Error' WHEN status >= 500 THEN 'Server Error' WHEN status IS NULL THEN 'Connection Error'
    WHEN robots IS NOT NULL OR x_robots_at IS NOT NULL THEN 'Noindex' WHEN canonical_1 <> url THEN 'Canonicalised' END AS reason FROM s),
p AS (SELECT *, CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS indexable, sha1(visible) AS content_hash, CASE WHEN fetched = 1 THEN description END AS descr FROM q),
h AS (SELECT * FROM p WHERE """ + H + r"""),
nav AS (SELECT id AS src_id, origin || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS dst_url, 1 AS follow FROM p WHERE fetched = 1),
stored AS (SELECT * FROM nav UNION ALL SELECT id, link_1, 1 FROM p WHERE fetched = 1 AND link_1 IS NOT NULL UNION ALL SELECT id, link_2, 0 FROM p WHERE fetched = 1 AND link_2 IS NOT NULL),
shown AS (SELECT id AS src_id, unnest([render_link_1, render_link_2, render_link_2]) AS dst_url, 1 AS follow FROM h WHERE rendered_at = 1),
rl AS (SELECT * FROM shown WHERE dst_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stored WHERE stored.src_id = shown.src_id AND stored.dst_url = shown.dst_url)),
l AS (SELECT * FROM stored UNION ALL SELECT * FROM rl),
lk AS (SELECT l.*, p.id AS dst_id FROM l LEFT JOIN p ON p.url = l.dst_url),
sm AS (SELECT url FROM p WHERE id % 3 = 0 UNION ALL SELECT url || '-gone' FROM p WHERE id % 25 = 0),
img AS (SELECT id AS page_id, image_1 AS src, '' AS alt, 0 AS dims FROM p WHERE fetched = 1 AND image_1 IS NOT NULL UNION ALL SELECT id, image_2, 'b', 1 FROM p WHERE fetched = 1 AND image_2 IS NOT NULL UNION ALL SELECT id, image_3, repeat('x', 101), 1 FROM p WHERE fetched = 1 AND image_3 IS NOT NULL),
im AS (SELECT *, CASE WHEN src LIKE '%/big.png' THEN 600000 WHEN src LIKE '%/img/a0.png' THEN 300000 END AS bytes, CASE WHEN src LIKE '%/img/a2.png' THEN 404 WHEN src LIKE '%/big.png' OR src LIKE '%/img/a0.png' THEN 200 END AS status FROM img),
hl AS (SELECT id AS page_id, url, 1 AS place, lang_1 AS lang, href_1 AS href FROM p WHERE fetched = 1 AND href_1 IS NOT NULL UNION ALL SELECT id, url, 2, lang_2, href_2 FROM p WHERE fetched = 1 AND href_2 IS NOT NULL UNION ALL SELECT id, url, 3, lang_3, href_3 FROM p WHERE fetched = 1 AND href_3 IS NOT NULL),
sd AS (SELECT id AS page_id, data_type AS type FROM p WHERE fetched = 1 AND data_type IS NOT NULL),
no AS (SELECT *, coalesce(meta_robots, '') LIKE '%noindex%' OR coalesce(x_robots, '') LIKE '%noindex%' AS noindex FROM p),
w0(id, here, chain, statuses, is_loop, done) AS (SELECT id, redirect_target, [url], [status], false, false FROM p WHERE redirect_target IS NOT NULL
  UNION ALL SELECT w0.id, q.redirect_target, CASE WHEN list_contains(chain, here) THEN chain ELSE list_append(chain, here) END, CASE WHEN list_contains(chain, here) THEN statuses ELSE list_append(statuses, coalesce(q.status, 0)) END,
    list_contains(chain, here), list_contains(chain, here) OR q.redirect_target IS NULL FROM w0 LEFT JOIN p q ON q.url = here WHERE NOT done),
walk AS (SELECT id, chain, statuses, is_loop FROM w0 WHERE done)
"""
)

ISSUES = {
    "response": r"""SELECT 'response-broken-internal' AS check_id, id AS page_id, status || ' — ' || (SELECT count(*) FROM lk WHERE lk.dst_id = p.id) || ' inlinks' AS detail FROM p WHERE is_internal = 1 AND status BETWEEN 400 AND 499
UNION ALL SELECT 'response-broken-external', id, status || ' — linked from ' || (SELECT count(*) FROM lk WHERE lk.dst_url = p.url) || ' pages' FROM p WHERE is_internal = 0 AND status >= 400
UNION ALL SELECT 'response-5xx', id, CAST(status AS VARCHAR) FROM p WHERE is_internal = 1 AND status >= 500
UNION ALL SELECT 'response-no-response', id, 'reset' FROM p WHERE is_internal = 1 AND fetched = 2
UNION ALL SELECT 'response-302-internal', id, CAST(status AS VARCHAR) FROM p WHERE is_internal = 1 AND status IN (302, 307)""",
    "redirects": """SELECT 'response-redirect-loop' AS check_id, id AS page_id, array_to_string(chain, ' → ') AS detail FROM walk WHERE is_loop
UNION ALL SELECT 'response-redirect-chain', id, (len(chain) - 1) || ' hops' FROM walk WHERE NOT is_loop AND len(chain) > 2""",
    "directives": """SELECT 'directives-noindex' AS check_id, id AS page_id, coalesce(meta_robots, x_robots) AS detail FROM no WHERE is_internal = 1 AND fetched = 1 AND (noindex OR meta_robots LIKE '%none%')
UNION ALL SELECT 'directives-nofollow-page', id, meta_robots FROM p WHERE is_internal = 1 AND fetched = 1 AND meta_robots LIKE '%nofollow%'
UNION ALL SELECT 'directives-robots-blocked', id, NULL FROM p WHERE is_internal = 1 AND fetched = 3
UNION ALL SELECT 'directives-noindex-in-sitemap', id, NULL FROM no WHERE in_sitemap = 1 AND noindex""",
    "canonicals": """SELECT 'canonical-missing' AS check_id, id AS page_id, CAST(NULL AS VARCHAR) AS detail FROM h WHERE canonical IS NULL AND link_header IS NULL AND indexable = 1
UNION ALL SELECT 'canonical-multiple-conflicting', id, canonical || ' | ' || canonical_2 FROM h WHERE canonical_2 IS NOT NULL
UNION ALL SELECT 'canonical-conflict-header', id, canonical || ' vs ' || link_header FROM h WHERE canonical <> link_header
UNION ALL SELECT CASE WHEN t.status BETWEEN 300 AND 399 THEN 'canonical-to-redirect' ELSE 'canonical-to-non200' END, a.id, a.canonical || ' → ' || t.status FROM p a JOIN p t ON t.url = a.canonical AND t.fetched = 1 WHERE a.is_internal = 1 AND a.fetched = 1 AND a.canonical <> a.url AND t.status <> 200
UNION ALL SELECT 'canonical-to-noindex', a.id, a.canonical FROM p a JOIN no t ON t.url = a.canonical AND t.fetched = 1 WHERE a.is_internal = 1 AND a.fetched = 1 AND a.canonical <> a.url AND t.noindex
UNION ALL SELECT 'canonical-unlinked', id, canonical FROM p WHERE is_internal = 1 AND fetched = 1 AND canonical <> url AND canonical NOT IN (SELECT dst_url FROM l)""",
    "titles": f"""SELECT 'title-missing' AS check_id, id AS page_id, CAST(NULL AS VARCHAR) AS detail FROM h WHERE title = ''
UNION ALL SELECT 'title-duplicate', id, title FROM h WHERE title <> '' AND title IN (SELECT title FROM h GROUP BY title HAVING count(*) > 1)
UNION ALL SELECT 'title-over-chars', id, length(title) || ' chars' FROM h WHERE length(title) > 60
UNION ALL SELECT 'title-under-chars', id, length(title) || ' chars' FROM h WHERE title <> '' AND length(title) < 30
UNION ALL SELECT 'title-over-px', id, {px("title", TITLE_PX)} || 'px' FROM h WHERE title <> '' AND {px("title", TITLE_PX)} > 600
UNION ALL SELECT 'title-multiple', id, '2 title tags' FROM h WHERE title_count_at = 2""",
    "descriptions": f"""SELECT 'desc-missing' AS check_id, id AS page_id, CAST(NULL AS VARCHAR) AS detail FROM h WHERE coalesce(descr, '') = '' AND indexable = 1
UNION ALL SELECT 'desc-duplicate', id, NULL FROM h WHERE descr <> '' AND descr IN (SELECT descr FROM h GROUP BY descr HAVING count(*) > 1)
UNION ALL SELECT 'desc-over-chars', id, length(descr) || ' chars' FROM h WHERE length(descr) > 160
UNION ALL SELECT 'desc-under-chars', id, length(descr) || ' chars' FROM h WHERE descr <> '' AND length(descr) < 70
UNION ALL SELECT 'desc-over-px', id, {px("descr", DESC_PX)} || 'px' FROM h WHERE descr <> '' AND {px("descr", DESC_PX)} > 920
UNION ALL SELECT 'desc-multiple', id, '2 meta descriptions' FROM h WHERE description_count = 2""",
    "headings": """SELECT 'h1-multiple' AS check_id, id AS page_id, '2 H1 tags' AS detail FROM h WHERE h1_2 IS NOT NULL
UNION ALL SELECT 'h1-duplicate', id, h1_1 FROM h WHERE h1_1 <> '' AND h1_1 IN (SELECT h1_1 FROM h GROUP BY h1_1 HAVING count(*) > 1)
UNION ALL SELECT 'h2-missing', id, NULL FROM h WHERE h2_1 IS NULL AND word_count > 300""",
    "images": """SELECT 'img-missing-alt' AS check_id, page_id, count(*) || ' images without alt' AS detail FROM im WHERE alt = '' GROUP BY page_id
UNION ALL SELECT 'img-alt-long', page_id, count(*) || ' images' FROM im WHERE length(alt) > 100 GROUP BY page_id
UNION ALL SELECT 'img-over-warn', page_id, count(DISTINCT src) || ' images over 200KB' FROM im WHERE bytes > 204800 AND bytes <= 512000 GROUP BY page_id
UNION ALL SELECT 'img-over-critical', page_id, count(DISTINCT src) || ' images over 500KB' FROM im WHERE bytes > 512000 GROUP BY page_id
UNION ALL SELECT 'img-broken', page_id, count(DISTINCT src) || ': ' || string_agg(DISTINCT src, ',') FROM im WHERE status >= 400 GROUP BY page_id
UNION ALL SELECT 'img-no-dimensions', page_id, count(*) || ' images' FROM im WHERE dims = 0 GROUP BY page_id""",
    "content": """SELECT 'content-thin' AS check_id, id AS page_id, word_count || ' words' AS detail FROM h WHERE indexable = 1 AND word_count < 200
UNION ALL SELECT 'content-exact-duplicate', id, NULL FROM h WHERE word_count > 30 AND content_hash IN (SELECT content_hash FROM h WHERE word_count > 30 GROUP BY content_hash HAVING count(*) > 1)""",
    "urls": r"""SELECT 'url-too-long' AS check_id, id AS page_id, length(url) || ' chars' AS detail FROM p WHERE """ + H + r""" AND length(url) > 40
UNION ALL SELECT 'url-uppercase', id, NULL FROM h WHERE regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[A-Z]')
UNION ALL SELECT 'url-underscores', id, NULL FROM h WHERE contains(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '_')
UNION ALL SELECT 'url-params', id, regexp_extract(url, '(\?[^#]+)', 1) FROM h WHERE url LIKE '%?_%'""",
    "security": """SELECT 'security-not-https' AS check_id, id AS page_id, CAST(NULL AS VARCHAR) AS detail FROM h WHERE url LIKE 'http:%'
UNION ALL SELECT 'security-missing-hsts', id, NULL FROM h WHERE url LIKE 'https:%' AND NOT hsts UNION ALL SELECT 'security-missing-xcto', id, NULL FROM h WHERE url LIKE 'https:%' AND NOT xcto
UNION ALL SELECT 'security-missing-csp', id, NULL FROM h WHERE url LIKE 'https:%' AND NOT csp UNION ALL SELECT 'security-missing-referrer', id, NULL FROM h WHERE url LIKE 'https:%' AND NOT referrer
UNION ALL SELECT 'security-missing-xfo', id, NULL FROM h WHERE url LIKE 'https:%' AND NOT xfo AND NOT frames
UNION ALL SELECT 'security-http-links', src_id, count(*) || ' links' FROM l JOIN p ON p.id = l.src_id WHERE p.url LIKE 'https:%' AND dst_url LIKE 'http://%' GROUP BY src_id
UNION ALL SELECT 'security-mixed-content', page_id, count(*) || ' images' FROM img JOIN p ON p.id = page_id WHERE p.url LIKE 'https:%' AND src LIKE 'http://%' GROUP BY page_id""",
    "site": """SELECT 'mobile-viewport-missing' AS check_id, id AS page_id, CAST(NULL AS VARCHAR) AS detail FROM h WHERE viewport_at IS NULL
UNION ALL SELECT 'site-deep-pages', id, 'depth ' || depth FROM h WHERE depth > 3
UNION ALL SELECT 'site-ai-crawlers', NULL, unnest(['GPTBot', 'ClaudeBot']) || ' blocked by robots.txt'""",
    "pagination": """SELECT 'pagination-to-non200' AS check_id, h.id AS page_id, 'rel=' || r.rel || ' → ' || r.target || CASE WHEN t.fetched = 2 THEN ' (no response)' ELSE ' (' || t.status || ')' END AS detail
  FROM h JOIN (SELECT id, 'next' AS rel, next_at AS target FROM h UNION ALL SELECT id, 'prev', prev_at FROM h) r USING (id) JOIN p t ON t.url = r.target WHERE t.fetched = 2 OR t.status <> 200
UNION ALL SELECT 'pagination-canonicalised', id, 'canonical → ' || canonical FROM h WHERE prev_at IS NOT NULL AND canonical <> url""",
    "hreflang": """SELECT 'hreflang-invalid-code' AS check_id, page_id, 'fr_FR' AS detail FROM hl WHERE lang = 'fr_FR'
UNION ALL SELECT 'hreflang-no-self', page_id, NULL FROM hl GROUP BY page_id HAVING NOT bool_or(href = url)
UNION ALL SELECT 'hreflang-no-xdefault', page_id, NULL FROM hl GROUP BY page_id HAVING NOT bool_or(lang = 'x-default')
UNION ALL SELECT 'hreflang-missing-return', page_id, string_agg(DISTINCT href, ', ') FROM hl a WHERE href <> url AND lang <> 'x-default' AND href IN (SELECT url FROM hl) AND NOT EXISTS (SELECT 1 FROM hl z WHERE z.url = a.href AND z.href = a.url) GROUP BY page_id
UNION ALL SELECT 'hreflang-to-broken', page_id, string_agg(href || ' (HTTP ' || t.status || ')', ', ' ORDER BY place) FROM hl JOIN p t ON t.url = hl.href WHERE hl.href <> hl.url AND t.fetched = 1 AND t.status <> 200 GROUP BY page_id""",
    "structured": """SELECT 'sd-parse-error' AS check_id, page_id, CAST(NULL AS VARCHAR) AS detail FROM sd WHERE type = 'PARSE_ERROR'
UNION ALL SELECT 'sd-missing-required', page_id, CASE type WHEN 'Product' THEN 'product: name' WHEN 'Recipe' THEN 'recipe: image' ELSE 'event: location' END FROM sd WHERE type IN ('Product', 'Recipe', 'Event,Thing')
UNION ALL SELECT 'sd-missing-recommended', page_id, CASE type WHEN 'Product' THEN 'product: image; product: description; product: offers; product: aggregateRating; product: review; product: brand; product: sku'
  WHEN 'Recipe' THEN 'recipe: author; recipe: datePublished; recipe: description; recipe: prepTime; recipe: cookTime; recipe: totalTime; recipe: recipeYield; recipe: recipeIngredient; recipe: recipeInstructions; recipe: nutrition; recipe: aggregateRating'
  ELSE 'event: endDate; event: description; event: image; event: offers; event: performer; event: eventStatus; event: eventAttendanceMode' END FROM sd WHERE type IN ('Product', 'Recipe', 'Event,Thing')
UNION ALL SELECT 'sd-deprecated-type', page_id, type FROM sd WHERE type = 'FAQPage'""",
    "sitemaps": """SELECT 'sitemap-non200' AS check_id, id AS page_id, 'HTTP ' || status AS detail FROM sm JOIN p USING (url) WHERE fetched = 1 AND status <> 200
UNION ALL SELECT 'sitemap-noindex', id, NULL FROM p WHERE in_sitemap = 1 AND fetched = 1 AND reason = 'Noindex'
UNION ALL SELECT 'sitemap-canonicalised', id, canonical FROM p WHERE in_sitemap = 1 AND fetched = 1 AND canonical <> url
UNION ALL SELECT 'sitemap-orphan', NULL, sm.url FROM sm LEFT JOIN p USING (url) WHERE p.id IS NULL
UNION ALL SELECT 'sitemap-missing-indexable', id, NULL FROM h WHERE indexable = 1 AND in_sitemap = 0""",
    "rendering": """SELECT 'render-failed' AS check_id, id AS page_id, 'timeout' AS detail FROM h WHERE rendered_at = 2
UNION ALL SELECT 'render-console-errors', id, '2 error(s): boom' FROM h WHERE rendered_at = 1 AND id % 15 = 0
UNION ALL SELECT 'render-canonical-mismatch', id, 'raw=' || coalesce(canonical, '(none)') || ' rendered=' || coalesce(render_canonical, '(none)') FROM h WHERE rendered_at = 1 AND coalesce(canonical, '') <> coalesce(render_canonical, '')
UNION ALL SELECT 'render-title-changed', id, 'raw=' || title || ' rendered=' || 'Rendered' FROM h WHERE rendered_at = 1 AND id % 10 = 0 AND title <> 'Rendered'
UNION ALL SELECT 'render-robots-changed', id, 'raw=' || coalesce(meta_robots, '(none)') || ' rendered=' || CASE WHEN meta_robots IS NULL THEN 'noindex' ELSE 'nofollow , noindex' END FROM h WHERE rendered_at = 1 AND (meta_robots = 'none' OR meta_robots IS NULL AND id % 25 = 0)
UNION ALL SELECT 'render-content-delta', id, word_count || ' raw vs ' || (word_count + render_words) || ' rendered words' FROM h WHERE rendered_at = 1 AND render_words > 100 AND render_words > 0.5 * word_count""",
    "accessibility": """SELECT 'a11y-critical' AS check_id, id AS page_id, '1 critical: Needs a name' AS detail FROM h WHERE rendered_at = 1 AND id % 20 = 0
UNION ALL SELECT 'a11y-serious', id, '1 serious violation(s)' FROM h WHERE rendered_at = 1 AND id % 20 = 0
UNION ALL SELECT 'a11y-minor', id, '1 moderate/minor violation(s)' FROM h WHERE rendered_at = 1 AND id % 20 = 10""",
}
SIMHASH = r"""
, wd AS (SELECT id, url, content_hash, string_split(lower(visible), ' ') AS w FROM h WHERE word_count > 50 AND indexable = 1),
sg AS (SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: list_reduce([14695981039346656037::HUGEINT] || list_transform(string_split(array_to_string(w[i:i+2], ' '), ''), lambda c: ord(c)::HUGEINT), lambda a, c: (xor(a, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT))) AS x FROM wd),
vt AS (SELECT id, k, sum(CASE WHEN (x // (1::HUGEINT << k)) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM sg, (SELECT unnest(range(0, 64))::INT AS k) GROUP BY id, k),
sh AS (SELECT id, sum(CASE WHEN v > 0 THEN 1::HUGEINT << k ELSE 0::HUGEINT END)::HUGEINT AS s FROM vt GROUP BY id),
bd AS (SELECT id, s, band, (s // (1::HUGEINT << (16 * band))) % 65536 AS v FROM sh, (SELECT unnest(range(0, 4))::INT AS band)),
bk AS (SELECT *, min(id) OVER (PARTITION BY band, v) AS first FROM bd),
pr AS (SELECT a.first, a.band, a.id AS a, z.id AS z, bit_count(xor(a.s, z.s)) AS d FROM bk a JOIN bk z ON a.band = z.band AND a.v = z.v AND a.id < z.id JOIN p x ON x.id = a.id JOIN p y ON y.id = z.id WHERE x.content_hash <> y.content_hash AND bit_count(xor(a.s, z.s)) <= 6),
pe AS (SELECT a AS page_id, z AS other, first, band, a, z, d FROM pr UNION ALL SELECT z, a, first, band, a, z, d FROM pr),
nd AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first, band, a, z) AS r FROM pe)
"""
NEAR = "SELECT 'content-near-duplicate' AS check_id, page_id, CAST(floor((1 - d / 64) * 100 + 0.5) AS INT) || '% similar to ' || url AS detail FROM nd JOIN p ON p.id = nd.other WHERE r = 1"
EVERY = PRELUDE.rstrip() + SIMHASH + ", i AS (" + "\nUNION ALL ".join([*(f"SELECT * FROM ({q})" for q in ISSUES.values()), f"SELECT * FROM ({NEAR})"]) + ")\n"


def query(name: str, run: Callable[[Project], DataFrame], sql: str | None, issues: bool = False) -> None:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run((audited if issues else crawl)(spark, sf_dir))

    call.__name__ = name
    QUERIES[name] = call
    if sql:
        ORACLE_SQL[name] = sql if sql.lstrip().startswith("WITH") else PRELUDE + sql


@lru_cache(4)
def _crawl(application: str, sf_dir: str) -> Project:
    from dataclasses import replace

    spark = SparkSession.getActiveSession()
    with joined_by_key(spark):
        found = project(spark, sf_dir)
    return Project(found.spark, found.tables, replace(found.config, max_url_length=40))


def crawl(spark: SparkSession, sf_dir: str) -> Project:
    """The annotated crawl, parsed and written once in a session."""
    return _crawl(spark.sparkContext.applicationId, sf_dir)


@lru_cache(4)
def _issues(application: str, sf_dir: str) -> DataFrame:
    return checks.written(crawl(SparkSession.getActiveSession(), sf_dir))


def audited(spark: SparkSession, sf_dir: str) -> Project:
    """The crawl with its issues, found and written once in a session."""
    return crawl(spark, sf_dir).with_tables(issues=_issues(spark.sparkContext.applicationId, sf_dir))


def module(names: list[str]) -> Callable[[Project], DataFrame]:
    return lambda p: checks.run(p, names)


NAMES = {"redirects": ["redirect_chains"], "site": ["site", "ai_crawlers"]}
for _name, _sql in ISSUES.items():
    query(f"checks_{_name}", module(NAMES.get(_name, [_name])), _sql)
query("checks_near_duplicates", module(["near_duplicate"]), PRELUDE.rstrip() + SIMHASH + NEAR)
query("all_issues", lambda p: p["issues"], EVERY + "SELECT * FROM i", True)

query("near_duplicate_pages", lambda p: near_duplicates.first_matches(views.html_pages(p).where("simhash is not null and word_count > 50 and indexable = 1"), p.config.near_duplicate), PRELUDE.rstrip() + SIMHASH + "SELECT page_id, other AS partner_id, url AS partner_url, CAST(floor((1 - d / 64) * 100 + 0.5) AS INT) AS similarity FROM nd JOIN p ON p.id = nd.other WHERE r = 1")

def details(p: Project) -> DataFrame:
    """Sizes of a page's tables, for some pages."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("id"), F.lit(name).alias("part"), "n") for i in (4, 65) for name, df in detail.page(p, i).items() if name in _DETAIL]
    return reduce(DataFrame.unionAll, parts)


_DETAIL = {
    "inlinks": "lk WHERE dst_id = {0}", "outlinks": "lk WHERE src_id = {0}", "images": "im WHERE page_id = {0}", "hreflang": "hl WHERE page_id = {0}", "structured_data": "sd WHERE page_id = {0}", "issues": "i WHERE page_id = {0}", "api_psi": "p WHERE id = {0} AND id % 4 = 0",
    "sitemaps": "sm JOIN p USING (url) WHERE p.id = {0}", "near_duplicates": "(SELECT other FROM nd WHERE r = 1 AND page_id = {0} UNION SELECT page_id FROM nd WHERE r = 1 AND other = {0})",
}
query("page_detail", details, EVERY + " UNION ALL ".join(f"SELECT {i} AS id, '{k}' AS part, count(*) AS n FROM {v.format(i)}" for i in (4, 65) for k, v in _DETAIL.items()), True)
#: What is compared of each list of a page's detail: a value of its rows, and the same in SQL.
_ROWS = {
    "outlinks": ("concat_ws('|', dst_url, follow, from_render, coalesce(cast(status as string), 'none'))", "SELECT array_to_string(list_transform(string_split(x.dst_url, ''), lambda c: CASE WHEN ord(c) > 127 THEN url_encode(c) ELSE c END), '') || '|' || x.follow || '|' || x.shown || '|' || coalesce(CAST(t.status AS VARCHAR), 'none') FROM (SELECT *, 0 AS shown FROM stored UNION ALL SELECT *, 1 FROM rl) x LEFT JOIN p t ON t.url = x.dst_url WHERE x.src_id = {0}"),
    "images": ("concat_ws('|', src, alt, has_dimensions, coalesce(bytes, 0), coalesce(status, 0))", "SELECT src || '|' || alt || '|' || dims || '|' || coalesce(bytes, 0) || '|' || coalesce(status, 0) FROM im WHERE page_id = {0}"),
    "hreflang": ("concat_ws('|', lang, href)", "SELECT lang || '|' || href FROM hl WHERE page_id = {0}"),
    "structured_data": ("type", "SELECT type FROM sd WHERE page_id = {0}"),
    "issues": ("concat_ws('|', check_id, coalesce(detail, ''))", "SELECT check_id || '|' || coalesce(detail, '') FROM i WHERE page_id = {0}"),
    "api_psi": ("concat_ws('|', performance, lcp_ms)", "SELECT (id % 100) || '|' || CAST(id % 50 * 100 AS DOUBLE) FROM p WHERE id = {0} AND id % 4 = 0"),
    "inlinks": ("concat_ws('|', source, follow, coalesce(status, 0))", "SELECT p.url || '|' || follow || '|' || coalesce(p.status, 0) FROM lk JOIN p ON p.id = src_id WHERE dst_id = {0}"),
    "sitemaps": ("sitemap", "SELECT 'sitemap.xml' FROM sm JOIN p USING (url) WHERE p.id = {0}"),
}
SHOWN_PAGES = (4, 30, 84)


def detail_rows(p: Project) -> DataFrame:
    """The rows of a page's tables, for some pages."""
    parts = [df.select(F.lit(i).alias("id"), F.lit(name).alias("part"), F.expr(_ROWS[name][0]).alias("value")) for i in SHOWN_PAGES for name, df in detail.page(p, i).items() if name in _ROWS]
    return reduce(DataFrame.unionAll, parts)


query("page_detail_rows", detail_rows, EVERY + " UNION ALL ".join(f"SELECT {i} AS id, '{k}' AS part, value FROM ({v[1].format(i)}) x(value)" for i in SHOWN_PAGES for k, v in _ROWS.items()), True)
query("graph_edges", lambda p: graphs.edges(p, p["pages"].where("is_internal = 1 and fetched = 1"), inside=False), "SELECT DISTINCT src_id, dst_id FROM lk JOIN p a ON a.id = src_id JOIN p z ON z.id = dst_id WHERE src_id <> dst_id AND a.is_internal = 1 AND z.is_internal = 1 AND a.fetched = 1 AND z.fetched = 1")
query("url_normalisation", lambda p: p["pages"].select("id", url.normalized(F.concat(F.lit(" HTTP://WWW.Example.com:80/a/../b c?q="), F.col("id").cast("string"), F.lit("#frag"))).alias("whole"), url.normalized(F.concat(F.lit("../x?"), F.col("id").cast("string")), F.lit("https://h.example/d/e/f")).alias("relative")), "SELECT id, 'http://www.example.com/b%20c?q=' || id AS whole, 'https://h.example/d/x?' || id AS relative FROM p")

# what the parser found
query("parsed_pages", lambda p: p["pages"].where("fetched = 1").selectExpr("id", "title", "title_count", "title_px", "meta_description", "meta_description_count", "meta_robots", "canonical", "canonical_header", "viewport", "get(h1, 0) h1_1", "size(h1) h1_count", "get(h2, 0) h2_1", "rel_next", "rel_prev", "word_count", "content_hash", "indexable", "indexability_reason"), f"""
SELECT id, title, CAST(title_count_at AS INT) AS title_count, CASE WHEN title <> '' THEN {px("title", TITLE_PX)} END AS title_px, descr AS meta_description, CAST(description_count AS INT) AS meta_description_count, meta_robots, canonical, link_header AS canonical_header, viewport_at AS viewport,
  h1_1, CASE WHEN h1_2 IS NULL THEN 1 ELSE 2 END AS h1_count, h2_1, next_at AS rel_next, prev_at AS rel_prev, word_count, content_hash, indexable, reason AS indexability_reason FROM p WHERE fetched = 1""".strip())
query("parsed_links", lambda p: p["links"].groupBy("src_id").agg(F.count("*").alias("n"), F.count("dst_id").alias("known"), F.sum("follow").cast("long").alias("followed"), F.sum("is_internal").cast("long").alias("inside")), """
SELECT src_id, count(*) AS n, count(dst_id) AS known, CAST(sum(follow) AS BIGINT) AS followed, CAST(count(*) FILTER (regexp_replace(regexp_extract(dst_url, '^https?://([^/?#]+)', 1), '^www\\.', '') = regexp_replace(regexp_extract(p.url, '^https?://([^/?#]+)', 1), '^www\\.', '')) AS BIGINT) AS inside FROM lk JOIN p ON p.id = lk.src_id GROUP BY src_id""".strip())
query("parsed_images", lambda p: p["image_refs"].join(p["images"].selectExpr("id image_id", "src", "bytes", "status"), "image_id").select("page_id", "src", "alt", "has_dimensions", "bytes", "status"), "SELECT page_id, src, alt, dims AS has_dimensions, CAST(bytes AS BIGINT) AS bytes, status FROM im")
query("parsed_hreflang", lambda p: p["hreflang"].select("page_id", "lang", "href"), "SELECT page_id, lang, href FROM hl")
query("parsed_structured_data", lambda p: p["structured_data"].selectExpr("page_id", "type", "json", "size(errors) errors", "size(warnings) warnings"), """
SELECT id AS page_id, data_type AS type, data_json AS json, CAST(CASE WHEN data_type = 'FAQPage' THEN 0 ELSE 1 END AS INT) AS errors, CAST(CASE data_type WHEN 'Product' THEN 7 WHEN 'Recipe' THEN 11 WHEN 'Event,Thing' THEN 7 ELSE 0 END AS INT) AS warnings FROM p WHERE fetched = 1 AND data_type IS NOT NULL""".strip())
query("custom_extraction", lambda p: p["extractions"].select("page_id", "extractor_id", "value"), r"""
SELECT id AS page_id, 'first' AS extractor_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS value FROM h0 UNION ALL SELECT id, 'heads', h1_1 FROM h0 WHERE h1_1 <> '' UNION ALL SELECT id, 'heads', h1_2 FROM h0 WHERE h1_2 IS NOT NULL UNION ALL SELECT id, 'marks', unnest(regexp_extract_all(html, '(?i)part (\d)', 1)) FROM h0 UNION ALL SELECT id, 'marks', regexp_extract(h2_1, 'Part (\d)', 1) FROM h0 WHERE h2_1 IS NOT NULL""".strip())
query("custom_search", lambda p: p["search_hits"].select("page_id", "search_id", "hits"), """
SELECT id AS page_id, 'literal' AS search_id, CAST(len(string_split(html, 'href')) - 1 + (CASE WHEN CASE WHEN rendered_at = 1 THEN render_canonical ELSE canonical_1 END IS NULL THEN 0 ELSE 1 END) + CASE WHEN rendered_at = 1 THEN (CASE WHEN render_link_1 IS NULL THEN 0 ELSE 1 END) + 2 * (CASE WHEN render_link_2 IS NULL THEN 0 ELSE 1 END) ELSE 0 END + (CASE WHEN canonical_2 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN next_at IS NULL THEN 0 ELSE 1 END) + (CASE WHEN prev_at IS NULL THEN 0 ELSE 1 END)
  + 2 * (CASE WHEN href_1 IS NULL THEN 0 ELSE 1 END) + 2 * (CASE WHEN href_2 IS NULL THEN 0 ELSE 1 END) + 2 * (CASE WHEN href_3 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN link_1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN link_2 IS NULL THEN 0 ELSE 1 END) AS INT) AS hits FROM h0
UNION ALL SELECT id, 'pattern', CAST(len(regexp_extract_all(html, '(?i)<p>')) AS INT) FROM h0 UNION ALL SELECT id, 'broken', 0 FROM h0""".strip())
query("link_canonicals_and_status", lambda p: p["pages"].select("id", "status_text", "segment"), """
SELECT id, CASE status WHEN 200 THEN 'OK' WHEN 301 THEN 'Moved Permanently' WHEN 302 THEN 'Found' WHEN 404 THEN 'Not Found' WHEN 500 THEN 'Internal Server Error' ELSE '' END AS status_text,
  CASE WHEN is_internal = 1 THEN CASE WHEN url LIKE '%?page=%' THEN 'paged' WHEN contains(url, 'utm_') THEN 'campaign' WHEN url LIKE 'https:%' THEN 'secure' END END AS segment FROM p""".strip())
ORACLE_SQL["custom_extraction"] = ORACLE_SQL["custom_extraction"].replace("nav AS (", "h0 AS (SELECT * FROM p WHERE is_internal = 1 AND fetched = 1 AND status = 200),\nnav AS (", 1)
ORACLE_SQL["custom_search"] = ORACLE_SQL["custom_search"].replace("nav AS (", "h0 AS (SELECT * FROM p WHERE is_internal = 1 AND fetched = 1 AND status = 200),\nnav AS (", 1)

# summaries of the issues
SEVERITY = "(SELECT unnest([" + ", ".join(f"'{k}'" for k in checks.REGISTRY) + "]) AS check_id, unnest([" + ", ".join(f"'{c}'" for c, _ in checks.REGISTRY.values()) + "]) AS category, unnest([" + ", ".join(f"'{s}'" for _, s in checks.REGISTRY.values()) + "]) AS severity, unnest([" + ", ".join(f"{checks.WEIGHTS[s]}" for _, s in checks.REGISTRY.values()) + "])::DOUBLE AS weight)"
query("issue_summary", lambda p: reports.issue_summary(p, p["issues"]), EVERY + f"SELECT check_id, category, severity, weight, count(*) AS n FROM i JOIN {SEVERITY} USING (check_id) GROUP BY ALL", True)
query("category_health", lambda p: reports.category_health(p, p["issues"]), EVERY + f"SELECT category, CAST(count(*) AS BIGINT) AS issues, CAST(greatest(0, floor(100 - sum(weight) / (SELECT count(*) FROM h) * 100 + 0.5)) AS BIGINT) AS score FROM i JOIN {SEVERITY} USING (check_id) GROUP BY category", True)
query("site_health", lambda p: reports.site_health(p, p["issues"]), EVERY + f"SELECT CAST(floor(avg(score) + 0.5) AS BIGINT) AS score FROM (SELECT greatest(0, floor(100 - sum(weight) / (SELECT count(*) FROM h) * 100 + 0.5)) AS score FROM i JOIN {SEVERITY} USING (check_id) GROUP BY category)", True)
query("worst_pages", lambda p: reports.worst_pages(p, p["issues"]).withColumn("weight", F.round("weight", 3)), EVERY + f"SELECT t.page_id, t.issues, round(t.weight, 3) AS weight, p.url FROM (SELECT * FROM (SELECT page_id, count(*) AS issues, sum(weight) AS weight FROM i JOIN {SEVERITY} USING (check_id) WHERE page_id IS NOT NULL GROUP BY page_id ORDER BY issues DESC, page_id LIMIT 30) ORDER BY weight DESC, issues DESC, page_id LIMIT 10) t JOIN p ON p.id = t.page_id", True)
query("segment_summary", reports.segments, "SELECT segment, count(*) AS pages, CAST(sum(indexable) AS BIGINT) AS indexable FROM (SELECT *, CASE WHEN url LIKE '%?page=%' THEN 'paged' WHEN contains(url, 'utm_') THEN 'campaign' WHEN url LIKE 'https:%' THEN 'secure' END AS segment FROM p WHERE is_internal = 1) WHERE segment IS NOT NULL GROUP BY segment")

# counts of every view and filter
ISSUE = "id IN (SELECT page_id FROM i WHERE check_id = '{}')"
DUP = "{0} IN (SELECT {0} FROM h WHERE {0} <> '' GROUP BY 1 HAVING count(*) > 1)"
ROBOTS = "(coalesce(meta_robots, '') LIKE '%{0}%' OR coalesce(x_robots, '') LIKE '%{0}%')"
RENDER = "(rendered_at = 1 AND coalesce(canonical, '') <> coalesce(render_canonical, ''))"
TITLE_CHANGED, ROBOTS_CHANGED = "(rendered_at = 1 AND id % 10 = 0 AND title <> 'Rendered')", "(rendered_at = 1 AND coalesce(meta_robots, '') <> coalesce(render_robots, ''))"
RENDER_LINKS = "(SELECT count(*) FROM rl WHERE src_id = h.id)"
COUNTS = {
    "internal": ("p WHERE is_internal = 1", {"html": "true", "indexable": "indexable = 1", "non-indexable": "indexable = 0", "rendered": "rendered_at = 1"}),
    "external": ("p WHERE is_internal = 0", {"broken": "status >= 400", "redirect": "status BETWEEN 300 AND 399", "error": "fetched = 2"}),
    "response_codes": ("p WHERE true", {"success": "status BETWEEN 200 AND 299", "redirect": "status BETWEEN 300 AND 399", "redirect-chain": "id IN (SELECT id FROM walk WHERE len(chain) > 1)", "client-error": "status BETWEEN 400 AND 499", "server-error": "status >= 500", "no-response": "fetched = 2", "blocked": "fetched = 3"}),
    "titles": ("h WHERE true", {"missing": "title = ''", "duplicate": DUP.format("title"), "over-chars": "length(title) > 60", "under-chars": "title <> '' AND length(title) < 30", "over-px": f"title <> '' AND {px('title', TITLE_PX)} > 600", "multiple": "title_count_at > 1"}),
    "meta_descriptions": ("h WHERE true", {"missing": "coalesce(descr, '') = ''", "duplicate": DUP.format("descr"), "over-chars": "length(descr) > 160", "under-chars": "descr <> '' AND length(descr) < 70", "over-px": f"descr <> '' AND {px('descr', DESC_PX)} > 920", "multiple": "description_count > 1"}),
    "h1": ("h WHERE true", {"missing": "false", "multiple": "h1_2 IS NOT NULL", "duplicate": "h1_1 IN (SELECT h1_1 FROM h GROUP BY 1 HAVING count(*) > 1)"}),
    "h2": ("h WHERE true", {"missing": "h2_1 IS NULL"}),
    "content": ("h WHERE true", {"thin": ISSUE.format("content-thin"), "exact-duplicate": DUP.format("content_hash"), "near-duplicate": ISSUE.format("content-near-duplicate")}),
    "images": ("(SELECT src, any_value(bytes) AS bytes, any_value(status) AS status, count(*) FILTER (alt = '') AS missing FROM im GROUP BY src) WHERE true", {"over-warn": "bytes >= 204800", "over-critical": "bytes >= 512000", "missing-alt": "missing > 0", "broken": "status >= 400"}),
    "canonicals": ("h WHERE true", {"missing": "canonical IS NULL AND link_header IS NULL", "self": "canonical = url", "canonicalised": "canonical <> url", "multiple": "canonical_2 IS NOT NULL OR canonical <> link_header"}),
    "directives": ("p WHERE is_internal = 1", {"noindex": ROBOTS.format("noindex"), "nofollow": ROBOTS.format("nofollow"), "blocked": "fetched = 3"}),
    "hreflang": ("h WHERE true", {"with": "id IN (SELECT page_id FROM hl)"}),
    "structured_data": ("h WHERE true", {"with": "data_type IS NOT NULL", "missing": "data_type IS NULL", "errors": "data_type <> 'FAQPage'", "warnings": "data_type IN ('Product', 'Recipe', 'Event,Thing')"}),
    "sitemaps": ("sm WHERE true", {"in-sitemap": "true", "orphan": "url NOT IN (SELECT url FROM p)", "non-indexable": "url IN (SELECT url FROM p WHERE indexable = 0)"}),
    "js_rendering": ("h WHERE true", {"rendered": "rendered_at = 1", "changed": f"{TITLE_CHANGED} OR {RENDER} OR {ROBOTS_CHANGED} OR {RENDER_LINKS} > 0", "canonical-mismatch": f"{RENDER} AND render_canonical IS NOT NULL", "js-errors": "id % 15 = 0", "spa": "false", "render-failed": "rendered_at = 2"}),
    "accessibility": ("h WHERE rendered_at = 1", {"with-violations": "id % 20 IN (0, 10)", "critical": "id % 20 = 0", "serious": "id % 20 = 0", "clean": "id % 20 NOT IN (0, 10)"}),
    "search": ("(SELECT unnest([1, 1, 0]) AS hits FROM h) WHERE true", {"contains": "hits > 0", "not-contains": "hits = 0"}),
    "compare": ("p WHERE id % 6 < 5", {"ok": "id % 6 IN (0, 4)", "redirected": "id % 6 = 1", "broken": "id % 6 = 2", "missing": "id % 6 = 3", "title-changed": "id % 6 = 0 AND id % 4 = 0", "canonical-changed": "id % 6 IN (0, 4) AND id % 8 = 4"}),
    "gsc": ("p WHERE is_internal = 1 AND fetched = 1", {"with-data": "id % 7 = 0 AND id % 35 <> 0", "no-data": "id % 7 <> 0 OR id % 35 = 0"}),
    "ga4": ("p WHERE is_internal = 1 AND fetched = 1", {"with-data": "id % 5 = 0"}),
    "psi": ("p WHERE is_internal = 1 AND fetched = 1", {"with-data": "id % 4 = 0", "poor-lcp": "id % 4 = 0 AND id % 50 * 100 > 2500", "poor-inp": "id % 8 = 0 AND id % 7 * 100 > 200", "poor-cls": "id % 4 = 0 AND id % 3 > 1"}),
    "backlinks": ("p WHERE is_internal = 1 AND fetched = 1", {"with-data": "id % 9 = 0"}),
}
_counts = [f"SELECT '{v}' AS view, CAST({repr(f) if f else 'NULL'} AS VARCHAR) AS filter, CAST(count(*) AS BIGINT) AS n FROM {base} AND ({k})" for v, (base, filters) in COUNTS.items() for f, k in {None: "true", **filters}.items()]
_counts.append("SELECT 'sitemaps', 'not-in-sitemap', count(*) FROM h WHERE in_sitemap = 0 AND indexable = 1")
_counts.append("SELECT 'gsc', 'orphan', count(*) FROM p WHERE id % 35 = 0")
_counts.append("SELECT 'extraction', NULL, (SELECT sum(len(regexp_extract_all(html, '<li><a href=')) + len(regexp_extract_all(html, '(?i)part \\d')) + CASE WHEN h1_1 <> '' THEN 1 ELSE 0 END + CASE WHEN h1_2 IS NULL THEN 0 ELSE 1 END + CASE WHEN h2_1 IS NULL THEN 0 ELSE 1 END)::BIGINT FROM h)")
query("overview_counts", views.overview, EVERY + "\nUNION ALL ".join(_counts), True)

# rows of views
def view(name: str, columns: str, sql: str, filter_id: str | None = None, issues: bool = False) -> None:
    query(f"view_{name}" + (f"_{filter_id}".replace("-", "_").replace(":", "_") if filter_id else ""), lambda p: views.rows(p, name, filter_id).selectExpr(*columns.split(", ")), sql, issues)


view("external", "id, url, inlinks", "SELECT id, url, (SELECT count(*) FROM l WHERE dst_url = p.url) AS inlinks FROM p WHERE is_internal = 0")
view("meta_descriptions", "id, meta_description, desc_chars", "SELECT id, descr AS meta_description, CAST(length(coalesce(descr, '')) AS INT) AS desc_chars FROM h")
view("meta_descriptions", "id, desc_chars", "SELECT id, CAST(length(descr) AS INT) AS desc_chars FROM h WHERE length(descr) > 160", "over-chars")
view("gsc", "url, clicks", "SELECT 'https://orphan.example/' || id AS url, CAST(id % 11 AS INT) AS clicks FROM p WHERE id % 35 = 0", "orphan")
view("h2", "id, h2_1, h2_count", "SELECT id, h2_1, CASE WHEN h2_1 IS NULL THEN 0 ELSE 1 END AS h2_count FROM h")
view("images", "src, refs, missing_alt, bytes, status", "SELECT src, count(*) AS refs, count(*) FILTER (alt = '') AS missing_alt, CAST(any_value(bytes) AS BIGINT) AS bytes, any_value(status) AS status FROM im GROUP BY src")
view("hreflang", "id, hreflang_count, langs", "SELECT id, (SELECT count(*) FROM hl WHERE page_id = h.id) AS hreflang_count, (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM hl WHERE page_id = h.id) AS langs FROM h")
view("structured_data", "id, sd_count, sd_types, sd_errors", "SELECT id, CAST(CASE WHEN data_type IS NULL THEN 0 ELSE 1 END AS BIGINT) AS sd_count, data_type AS sd_types, CAST(CASE WHEN data_type <> 'FAQPage' THEN 1 ELSE 0 END AS BIGINT) AS sd_errors FROM h")
view("js_rendering", "id, title_changed, canonical_changed, robots_changed, word_delta, render_links, console_error_count", f"SELECT id, CASE WHEN {TITLE_CHANGED} THEN 'Yes' ELSE '' END AS title_changed, CASE WHEN {RENDER} THEN 'Yes' ELSE '' END AS canonical_changed, CASE WHEN {ROBOTS_CHANGED} THEN 'Yes' ELSE '' END AS robots_changed, CASE WHEN rendered_at = 1 THEN CAST(render_words AS INT) END AS word_delta, {RENDER_LINKS} AS render_links, CASE WHEN id % 15 = 0 THEN 2 ELSE 0 END AS console_error_count FROM h")
view("accessibility", "id, a11y_total, a11y_critical, a11y_serious, a11y_moderate, a11y_minor", "SELECT id, CASE id % 20 WHEN 0 THEN 2 WHEN 10 THEN 1 ELSE 0 END AS a11y_total, CASE WHEN id % 20 = 0 THEN 1 ELSE 0 END AS a11y_critical, CASE WHEN id % 20 = 0 THEN 1 ELSE 0 END AS a11y_serious, 0 AS a11y_moderate, CASE WHEN id % 20 = 10 THEN 1 ELSE 0 END AS a11y_minor FROM h WHERE rendered_at = 1")
view("canonicals", "id, canonical, canonical_header, indexability_reason", "SELECT id, canonical, link_header AS canonical_header, reason AS indexability_reason FROM h WHERE canonical <> url", "canonicalised")
view("directives", "id, meta_robots, x_robots", f"SELECT id, meta_robots, x_robots FROM p WHERE is_internal = 1 AND {ROBOTS.format('noindex')}", "noindex")
view("extraction", "page_id, extractor, value", ORACLE_SQL["custom_extraction"].replace("SELECT id AS page_id, 'first' AS extractor_id,", "SELECT id AS page_id, 'first' AS extractor,"))
view("search", "page_id, search_name, hits", ORACLE_SQL["custom_search"].replace("'literal' AS search_id", "'literal' AS search_name"))
view("ga4", "id, sessions, engagement_rate", "SELECT id, CAST(id % 9 AS INT) AS sessions, CAST(id % 10 AS DOUBLE) / 10 AS engagement_rate FROM p WHERE is_internal = 1 AND fetched = 1 AND id % 5 = 0", "with-data")
view("psi", "id, performance, lcp_ms, field_inp_ms", "SELECT id, CAST(id % 100 AS INT) AS performance, CAST(id % 50 * 100 AS DOUBLE) AS lcp_ms, CASE WHEN id % 8 = 0 THEN CAST(id % 7 * 100 AS DOUBLE) END AS field_inp_ms FROM p WHERE is_internal = 1 AND fetched = 1 AND id % 4 = 0", "with-data")
view("backlinks", "id, provider, domain_rating, ref_domains", "SELECT id, 'moz' AS provider, CAST(id % 90 AS DOUBLE) AS domain_rating, CAST(id % 12 AS INT) AS ref_domains FROM p WHERE is_internal = 1 AND fetched = 1 AND id % 9 = 0", "with-data")
view("titles", "id, title", EVERY + f"SELECT id, title FROM h WHERE {ISSUE.format('title-multiple')}", "issue:title-multiple", True)
query("view_page_of_responses", lambda p: views.query(p, "response_codes", None, "PAGE", "status", True, 10, 50).select("url", "status"), "SELECT url, status FROM p WHERE url ILIKE '%page%' ORDER BY status DESC NULLS LAST, id LIMIT 50 OFFSET 10")
view("titles", "id, title, title_chars, indexability_reason", "SELECT id, title, CAST(length(coalesce(title, '')) AS INT) AS title_chars, reason AS indexability_reason FROM h")
view("content", "id, word_count, indexability_reason", "SELECT id, word_count, reason AS indexability_reason FROM h")
view("canonicals", "id, canonical, canonical_header", "SELECT id, canonical, link_header AS canonical_header FROM h WHERE canonical_2 IS NOT NULL OR canonical <> link_header", "multiple")
view("js_rendering", "id, render_links", f"SELECT id, {RENDER_LINKS} AS render_links FROM h WHERE {TITLE_CHANGED} OR {RENDER} OR {ROBOTS_CHANGED} OR {RENDER_LINKS} > 0", "changed")
view("js_rendering", "id, canonical, rendered_canonical", f"SELECT id, canonical, render_canonical AS rendered_canonical FROM h WHERE {RENDER} AND render_canonical IS NOT NULL", "canonical-mismatch")
view("psi", "id, inp_ms, field_inp_ms", "SELECT id, CAST(id % 6 * 100 AS DOUBLE) AS inp_ms, CAST(id % 7 * 100 AS DOUBLE) AS field_inp_ms FROM p WHERE is_internal = 1 AND fetched = 1 AND id % 8 = 0 AND id % 7 > 2", "poor-inp")
view("compare", "url, result, matched_url, title_changed, canonical_changed", "SELECT url, ['ok', 'redirected', 'broken', 'missing', 'ok'][id % 6 + 1] AS result, CASE WHEN id % 6 <> 3 THEN url END AS matched_url, CASE WHEN id % 6 = 0 AND id % 4 = 0 THEN 'Yes' ELSE '' END AS title_changed, CASE WHEN id % 6 IN (0, 4) AND id % 8 = 4 THEN 'Yes' ELSE '' END AS canonical_changed FROM p WHERE id % 6 < 5")
# a search is for the url alone, whatever else a view shows: 'part' is in headings, 'page' in descriptions and in urls
SEARCHED = [(v, t, s) for v, t in (("titles", "h"), ("meta_descriptions", "h"), ("h1", "h"), ("h2", "h"), ("extraction", "found")) for s in ("Part", "page", "A")]
FOUND = "found AS (SELECT x.*, p.url FROM (" + ORACLE_SQL["custom_extraction"][ORACLE_SQL["custom_extraction"].index("SELECT id AS page_id, 'first'"):] + ") x JOIN p ON p.id = x.page_id)\n"
query("view_searches", lambda p: reduce(DataFrame.unionAll, [views.rows(p, v, None, s).select(F.lit(v).alias("view"), F.lit(s).alias("search"), F.col("url")) for v, _, s in SEARCHED]), ORACLE_SQL["custom_extraction"].split("SELECT id AS page_id, 'first'")[0].rstrip() + ", " + FOUND + " UNION ALL ".join(f"SELECT '{v}' AS view, '{s}' AS search, url FROM {t} WHERE url ILIKE '%{s}%'" for v, t, s in SEARCHED))

# rendered pages
query("rendered_pages", lambda p: p["pages"].where(views.H + " and rendered = 1").selectExpr("id", "rendered_title", "rendered_meta_description", "rendered_canonical", "rendered_meta_robots", "get(rendered_h1, 0) rendered_h1", "rendered_word_count"), """
SELECT id, coalesce(render_title, title) AS rendered_title, descr AS rendered_meta_description, render_canonical AS rendered_canonical, render_robots AS rendered_meta_robots, h1_1 AS rendered_h1, CAST(word_count + render_words AS INT) AS rendered_word_count FROM h WHERE rendered_at = 1""".strip())
query("render_only_links", lambda p: p["links"].where("from_render = 1").select("src_id", "dst_url", "dst_id", "follow", "is_internal"), "SELECT rl.src_id, rl.dst_url, p.id AS dst_id, rl.follow, CAST(regexp_extract(rl.dst_url, '^https?://([^/?#]+)', 1) = regexp_extract(s.url, '^https?://([^/?#]+)', 1) AS INT) AS is_internal FROM rl JOIN p s ON s.id = rl.src_id LEFT JOIN p ON p.url = rl.dst_url")
