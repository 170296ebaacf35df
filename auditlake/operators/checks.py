"""Checks: each gives rows (check_id, page_id, detail); their union is the issues table."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.views import H, counts, distinct_links, duplicated, html_pages, with_counts
from .. import schema
from ..project import Project
from ..store import cut_all, joined_by_key
from . import near_duplicates, redirects

WEIGHTS = {"critical": 5.0, "high": 3.0, "medium": 1.0, "low": 0.4, "info": 0.0}
#: Crawlers asked about in robots.txt.
AI_CRAWLERS = ["GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "Claude-SearchBot", "PerplexityBot", "Google-Extended", "CCBot"]
#: Properties that a type must and should have; alternatives are joined by '|'.
SD_RULES = {
    "article": ([], ["headline", "image", "datePublished", "dateModified", "author", "publisher"]),
    "newsarticle": ([], ["headline", "image", "datePublished", "dateModified", "author", "publisher"]),
    "blogposting": ([], ["headline", "image", "datePublished", "dateModified", "author", "publisher"]),
    "product": (["name"], ["image", "description", "offers", "aggregateRating", "review", "brand", "sku"]),
    "recipe": (["name", "image"], ["author", "datePublished", "description", "prepTime", "cookTime", "totalTime", "recipeYield", "recipeIngredient", "recipeInstructions", "nutrition", "aggregateRating"]),
    "event": (["name", "startDate", "location"], ["endDate", "description", "image", "offers", "performer", "eventStatus", "eventAttendanceMode"]),
    "jobposting": (["title", "description", "datePosted", "hiringOrganization", "jobLocation"], ["baseSalary", "employmentType", "validThrough"]),
    "localbusiness": (["name", "address"], ["telephone", "openingHours", "geo", "priceRange", "image", "url"]),
    "organization": (["name"], ["url", "logo", "sameAs", "contactPoint"]),
    "breadcrumblist": (["itemListElement"], []),
    "videoobject": (["name", "thumbnailUrl", "uploadDate"], ["description", "duration", "contentUrl", "embedUrl"]),
    "faqpage": (["mainEntity"], []),
    "howto": (["name", "step"], []),
    "review": (["itemReviewed", "reviewRating", "author"], []),
    "aggregaterating": (["ratingValue", "reviewCount|ratingCount"], []),
    "person": (["name"], []),
    "website": ([], ["name", "url", "potentialAction"]),
}
SD_DEPRECATED = ("howto", "faqpage")
REGISTRY: dict[str, tuple[str, str]] = {}
CHECKS: list[Callable[[Project], DataFrame | list]] = []
_NOINDEX = "coalesce(meta_robots, '') ilike '%noindex%' or coalesce(x_robots, '') ilike '%noindex%'"


def check(category: str, **severities: str):
    def add(f):
        REGISTRY.update({k.replace("_", "-"): (category, v) for k, v in severities.items()})
        CHECKS.append(f)
        return f

    return add


@dataclass(frozen=True)
class Rule:
    """A check that a page's own row decides: a condition and the detail; in the condition ``good`` says that the page is internal, fetched well and HTML."""

    where: str
    check_id: str
    detail: str = "cast(null as string)"


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of all rules, from one pass over pages: each page makes an array of what it breaks."""
    found = [F.when(F.expr(r.where), F.struct(F.lit(r.check_id).alias("check_id"), F.expr(r.detail).cast("string").alias("detail"))) for r in rules]
    rows = pages.withColumn("good", F.expr(H)).select("id", F.filter(F.array(*found), lambda x: x.isNotNull()).alias("found"))
    return rows.select(F.col("id").cast("long").alias("page_id"), F.explode("found").alias("x")).select("x.check_id", "page_id", "x.detail")


def emit(df: DataFrame, check_id: str, detail: str = "cast(null as string)", page: str = "id") -> DataFrame:
    return df.select(F.lit(check_id).alias("check_id"), F.expr(page).cast("long").alias("page_id"), F.expr(detail).cast("string").alias("detail"))


@check("Response", response_broken_internal="high", response_broken_external="medium", response_5xx="critical", response_no_response="high", response_302_internal="low")
def response(p: Project) -> list[DataFrame | Rule]:
    pages = p["pages"]
    inner = with_counts(pages.where("is_internal = 1 and status between 400 and 499"), counts(p["links"], "dst_id", "n"), "n")
    outer = with_counts(pages.where("is_internal = 0 and status >= 400"), counts(p["links"], "dst_url", "n"), "n", "url")
    return [
        emit(inner, "response-broken-internal", "concat(status, ' — ', n, ' inlinks')"), emit(outer, "response-broken-external", "concat(status, ' — linked from ', n, ' pages')"),
        Rule("is_internal = 1 and status >= 500", "response-5xx", "status"), Rule("is_internal = 1 and fetched = 2", "response-no-response", "error"), Rule("is_internal = 1 and status in (302, 307)", "response-302-internal", "status"),
    ]


@check("Response", response_redirect_loop="high", response_redirect_chain="medium")
def redirect_chains(p: Project) -> list[DataFrame]:
    walked = redirects.chains(p["pages"])
    return [emit(walked.where("is_loop"), "response-redirect-loop", "array_join(transform(chain, c -> c.url), ' → ')"), emit(walked.where("not is_loop and size(chain) > 2"), "response-redirect-chain", "concat(size(chain) - 1, ' hops')")]


@check("Directives", directives_noindex="medium", directives_nofollow_page="medium", directives_robots_blocked="medium", directives_noindex_in_sitemap="high")
def directives(p: Project) -> list[Rule]:
    own = "is_internal = 1 and fetched = 1"
    return [
        Rule(f"{own} and ({_NOINDEX} or meta_robots ilike '%none%')", "directives-noindex", "coalesce(meta_robots, x_robots)"),
        Rule(f"{own} and (coalesce(meta_robots, '') ilike '%nofollow%' or coalesce(x_robots, '') ilike '%nofollow%')", "directives-nofollow-page", "meta_robots"),
        Rule("is_internal = 1 and fetched = 3", "directives-robots-blocked"), Rule(f"in_sitemap = 1 and ({_NOINDEX})", "directives-noindex-in-sitemap"),
    ]


@check("Canonicals", canonical_missing="low", canonical_multiple_conflicting="high", canonical_conflict_header="high", canonical_to_redirect="medium", canonical_to_non200="high", canonical_to_noindex="high", canonical_unlinked="low")
def canonicals(p: Project) -> list[DataFrame | Rule]:
    target = p["pages"].where("fetched = 1").select(F.col("url").alias("t_url"), F.col("status").alias("t_status"), F.expr(_NOINDEX).alias("t_noindex"))
    away = p["pages"].where("is_internal = 1 and fetched = 1 and canonical <> url")
    both = away.join(target, away["canonical"] == target["t_url"])
    linked = p["links"].where("link_type = 'ahref'").select("dst_url").distinct()
    return [
        Rule("good and canonical is null and canonical_header is null and indexable = 1", "canonical-missing"),
        Rule("good and size(array_distinct(canonical_all)) > 1", "canonical-multiple-conflicting", "array_join(canonical_all, ' | ')"),
        Rule("good and canonical <> canonical_header", "canonical-conflict-header", "concat(canonical, ' vs ', canonical_header)"),
        emit(both.where("t_status between 300 and 399"), "canonical-to-redirect", "concat(canonical, ' → ', t_status)"),
        emit(both.where("t_status <> 200 and not t_status between 300 and 399"), "canonical-to-non200", "concat(canonical, ' → ', t_status)"),
        emit(both.where("t_noindex"), "canonical-to-noindex", "canonical"), emit(away.join(linked, away["canonical"] == linked["dst_url"], "left_anti"), "canonical-unlinked", "canonical"),
    ]


def _text_checks(p: Project, column: str, prefix: str, low: int, high: int, px: int, noun: str, missing: str, dup_detail: str) -> list[DataFrame | Rule]:
    size = f"length(coalesce({column}, ''))"
    return [
        Rule(f"good and ({column} is null or {column} = '') {missing}", f"{prefix}-missing"), emit(duplicated(html_pages(p).where(f"{column} <> ''"), column), f"{prefix}-duplicate", dup_detail),
        Rule(f"good and {size} > {high}", f"{prefix}-over-chars", f"concat({size}, ' chars')"), Rule(f"good and {column} <> '' and {size} < {low}", f"{prefix}-under-chars", f"concat({size}, ' chars')"),
        Rule(f"good and {column}_px > {px}", f"{prefix}-over-px", f"concat({column}_px, 'px')"), Rule(f"good and {column}_count > 1", f"{prefix}-multiple", f"concat({column}_count, ' {noun}')"),
    ]


@check("Titles", title_missing="high", title_duplicate="medium", title_over_chars="low", title_under_chars="low", title_over_px="low", title_multiple="medium")
def titles(p: Project) -> list[DataFrame | Rule]:
    c = p.config
    return _text_checks(p, "title", "title", c.title_min, c.title_max, c.title_px, "title tags", "", "title")


@check("Descriptions", desc_missing="medium", desc_duplicate="low", desc_over_chars="low", desc_under_chars="low", desc_over_px="low", desc_multiple="low")
def descriptions(p: Project) -> list[DataFrame | Rule]:
    c = p.config
    return _text_checks(p, "meta_description", "desc", c.desc_min, c.desc_max, c.desc_px, "meta descriptions", "and indexable = 1", "cast(null as string)")


@check("Headings", h1_missing="medium", h1_multiple="low", h1_duplicate="low", h2_missing="low")
def headings(p: Project) -> list[DataFrame | Rule]:
    first = html_pages(p).withColumn("first", F.expr("get(h1, 0)")).where("first <> ''")
    none = "good and size(coalesce({}, array())) = 0"
    return [
        Rule(none.format("h1") + " and indexable = 1", "h1-missing"), Rule("good and size(h1) > 1", "h1-multiple", "concat(size(h1), ' H1 tags')"),
        emit(duplicated(first, "first"), "h1-duplicate", "first"), Rule(none.format("h2") + " and word_count > 300", "h2-missing"),
    ]


@check("Images", img_missing_alt="medium", img_alt_long="low", img_over_warn="low", img_over_critical="medium", img_broken="high", img_no_dimensions="low")
def images(p: Project) -> list[DataFrame]:
    refs, c = p["image_refs"], p.config
    image = p["images"].select(F.col("id").alias("image_id"), "src", "bytes", "status")
    both = refs.join(image, "image_id")
    per = lambda df: df.groupBy("page_id").agg(F.count("*").alias("n"))
    distinct = lambda df: df.groupBy("page_id").agg(F.count_distinct("image_id").alias("n"))
    broken = both.where("status >= 400").groupBy("page_id").agg(F.count_distinct("image_id").alias("n"), F.array_join(F.array_sort(F.collect_set("src")), ",").alias("srcs"))
    kb = lambda n: f"' images over {(n + 512) // 1024}KB'"
    return [
        emit(per(refs.where("alt is null or alt = ''")), "img-missing-alt", "concat(n, ' images without alt')", "page_id"), emit(per(refs.where("length(alt) > 100")), "img-alt-long", "concat(n, ' images')", "page_id"),
        emit(distinct(both.where(f"bytes > {c.image_warn} and bytes <= {c.image_critical}")), "img-over-warn", f"concat(n, {kb(c.image_warn)})", "page_id"),
        emit(distinct(both.where(f"bytes > {c.image_critical}")), "img-over-critical", f"concat(n, {kb(c.image_critical)})", "page_id"),
        emit(broken, "img-broken", "concat(n, ': ', substring(srcs, 1, 300))", "page_id"), emit(per(refs.where("has_dimensions = 0")), "img-no-dimensions", "concat(n, ' images')", "page_id"),
    ]


@check("Content", content_thin="medium", content_exact_duplicate="high", content_low_text_ratio="low")
def content(p: Project) -> list[DataFrame | Rule]:
    return [
        Rule(f"good and indexable = 1 and word_count < {p.config.word_count_min}", "content-thin", "concat(word_count, ' words')"), emit(duplicated(html_pages(p).where("word_count > 30"), "content_hash"), "content-exact-duplicate"),
        Rule("good and indexable = 1 and text_ratio < 0.08 and word_count > 0", "content-low-text-ratio", "concat(floor(text_ratio * 1000 + 0.5) div 10, if(floor(text_ratio * 1000 + 0.5) % 10 = 0, '', concat('.', floor(text_ratio * 1000 + 0.5) % 10)), '% text')"),
    ]


@check("Content", content_near_duplicate="medium")
def near_duplicate(p: Project) -> DataFrame:
    found = near_duplicates.first_matches(html_pages(p).where("simhash is not null and word_count > 50 and indexable = 1"), p.config.near_duplicate)
    return emit(found, "content-near-duplicate", "concat(similarity, '% similar to ', partner_url)", "page_id")


@check("URL", url_too_long="low", url_uppercase="low", url_underscores="low", url_params="low", url_non_ascii="low")
def urls(p: Project) -> list[Rule]:
    own = "is_internal = 1 and fetched = 1 and status = 200 and"
    path, search = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)", "regexp_extract(url, '([?][^#]+)', 1)"
    units = "octet_length(encode(url, 'UTF-16BE')) div 2"
    return [
        Rule(f"{own} {units} > {p.config.max_url_length}", "url-too-long", f"concat({units}, ' chars')"), Rule(f"{own} {path} rlike '[A-Z]'", "url-uppercase"), Rule(f"{own} contains({path}, '_')", "url-underscores"),
        Rule(f"{own} {search} <> ''", "url-params", search), Rule(f"{own} concat({path}, {search}) rlike '[^\\\\x00-\\\\x7F]'", "url-non-ascii"),
    ]


@check("Security", security_not_https="critical", security_missing_hsts="low", security_missing_xcto="low", security_missing_xfo="low", security_missing_csp="low", security_missing_referrer="low", security_http_links="medium", security_mixed_content="high")
def security(p: Project) -> list[DataFrame | Rule]:
    own = "is_internal = 1 and fetched = 1 and status = 200"
    https = f"{own} and url like 'https:%'"
    lacks = lambda k: f"coalesce(try_element_at(headers, '{k}'), '') = ''"
    secure = p["pages"].where("url like 'https:%'").select(F.col("id").alias("page_id"))
    links = p["links"].where("dst_url like 'http://%' and link_type = 'ahref'").select(F.col("src_id").alias("page_id"), "src_id", "id", "dst_url").join(secure, "page_id").groupBy("page_id").agg(distinct_links().alias("n"))
    image = p["images"].where("src like 'http://%'").select(F.col("id").alias("image_id"))
    mixed = p["image_refs"].join(image, "image_id").join(secure, "page_id").groupBy("page_id").agg(F.count("*").alias("n"))
    plain = {"hsts": "strict-transport-security", "xcto": "x-content-type-options", "csp": "content-security-policy", "referrer": "referrer-policy"}
    return [
        Rule(f"{own} and url like 'http:%'", "security-not-https"), *[Rule(f"{https} and {lacks(v)}", f"security-missing-{k}") for k, v in plain.items()],
        Rule(f"{https} and {lacks('x-frame-options')} and not coalesce(try_element_at(headers, 'content-security-policy'), '') ilike '%frame-ancestors%'", "security-missing-xfo"),
        emit(links, "security-http-links", "concat(n, ' links')", "page_id"), emit(mixed, "security-mixed-content", "concat(n, ' images')", "page_id"),
    ]


@check("Site", mobile_viewport_missing="medium", site_deep_pages="low")
def site(p: Project) -> list[Rule]:
    return [Rule("good and (viewport is null or viewport = '')", "mobile-viewport-missing"), Rule("good and depth > 3", "site-deep-pages", "concat('depth ', depth)")]


@check("Site", site_ai_crawlers="info")
def ai_crawlers(p: Project) -> DataFrame:
    from ..functions.robots import allowed

    meta = {r.key: r.value for r in p["meta"].where("key in ('robots_txt', 'robots_origin')").collect()}
    known = meta.get("robots_txt") and meta.get("robots_origin")
    blocked = [b for b in AI_CRAWLERS if known and not allowed(meta["robots_txt"], b, "/")]
    return p.spark.createDataFrame([("site-ai-crawlers", None, f"{b} blocked by robots.txt") for b in blocked], "check_id string, page_id long, detail string")


@check("Pagination", pagination_to_non200="medium", pagination_canonicalised="low")
def pagination(p: Project) -> list[DataFrame | Rule]:
    h = html_pages(p).where("rel_next is not null or rel_prev is not null")
    named = "array(named_struct('rel', 'next', 'target', rel_next), named_struct('rel', 'prev', 'target', rel_prev))"
    rels = h.select("id", F.explode(F.expr(f"filter({named}, r -> r.target <> '')")).alias("r")).select("id", "r.*")
    target = p["pages"].where("fetched >= 1").select(F.col("url").alias("target"), "status", "fetched")
    bad = rels.join(target, "target").where("fetched = 2 or status <> 200")
    return [
        emit(bad, "pagination-to-non200", "concat('rel=', rel, ' → ', target, if(fetched = 2, ' (no response)', concat(' (', status, ')')))"),
        Rule("good and rel_prev <> '' and canonical <> '' and canonical <> url", "pagination-canonicalised", "concat('canonical → ', canonical)"),
    ]


@check("Hreflang", hreflang_invalid_code="medium", hreflang_no_self="low", hreflang_no_xdefault="low", hreflang_missing_return="high", hreflang_to_broken="medium")
def hreflang(p: Project) -> list[DataFrame]:
    pages = p["pages"].select(F.col("id").alias("page_id"), "url")
    rows = p["hreflang"].join(pages, "page_id").withColumn("code", F.lower(F.trim("lang")))
    valid = "code = 'x-default' or code rlike '^[a-z]{2,3}(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?$'"
    bad = rows.where(f"not ({valid})").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("id", "lang"))).alias("b"))
    per = rows.groupBy("page_id").agg(F.bool_or(F.col("href") == F.col("url")).alias("own"), F.bool_or(F.col("code") == "x-default").alias("default"))
    away = rows.where("href <> url")
    others = away.where("code <> 'x-default'")
    declares = rows.select(F.col("url").alias("t")).distinct()
    back = rows.select(F.col("url").alias("t"), F.col("href").alias("u")).distinct()
    lost = others.join(declares, others["href"] == declares["t"], "left_semi").join(back, (others["href"] == back["t"]) & (others["url"] == back["u"]), "left_anti")
    lost = listed(lost, "href")
    target = p["pages"].where("fetched = 1 and status <> 200").select(F.col("url").alias("href"), (-F.col("id")).alias("target"), "status")
    # of several pages with one url each is named, the last first
    broken = listed(away.join(target, "href"), "concat(href, ' (HTTP ', status, ')')", "target")
    return [
        emit(bad, "hreflang-invalid-code", "array_join(array_distinct(transform(b, x -> x.lang)), ', ')", "page_id"), emit(per.where("not own"), "hreflang-no-self", page="page_id"),
        emit(per.where("not default"), "hreflang-no-xdefault", page="page_id"), emit(lost, "hreflang-missing-return", "array_join(b, ', ')", "page_id"), emit(broken, "hreflang-to-broken", "array_join(b, ', ')", "page_id"),
    ]


def listed(df: DataFrame, value: str, *of: str) -> DataFrame:
    """page_id and b, each page's distinct values in order of their first row; of: what makes equal values distinct, and goes before them in the order."""
    first = df.groupBy("page_id", F.expr(value).alias("v"), *of).agg(F.min("id").alias("id"))
    return first.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", *of, "v"))), lambda x: x["v"]).alias("b"))


def structured_rows(p: Project) -> DataFrame:
    """structured_data with the rule of its first type that has one: missing required and recommended properties."""
    rules = p.spark.createDataFrame([(k, [x.split("|") for x in required], recommended) for k, (required, recommended) in SD_RULES.items()], "rule string, required array<array<string>>, recommended array<string>")
    sd = p["structured_data"].withColumns({"tokens": F.expr("filter(transform(split(coalesce(type, ''), ','), t -> lower(trim(t))), t -> t <> '')"), "source": F.expr("if(format = 'microdata', coalesce(get_json_object(json, '$.properties'), json), json)")})
    sd = sd.withColumn("rule", F.expr(f"get(filter(tokens, t -> array_contains(array({', '.join(repr(k) for k in SD_RULES)}), t)), 0)"))
    sd = sd.withColumn("keys", F.expr("filter(coalesce(json_object_keys(source), array()), k -> not startswith(k, '@'))"))
    return sd.join(F.broadcast(rules), "rule", "left").withColumns({"lost": F.expr("transform(filter(required, r -> not arrays_overlap(r, keys)), r -> concat(rule, ': ', array_join(r, '|')))"), "wanted": F.expr("transform(array_except(recommended, keys), r -> concat(rule, ': ', r))")})


def with_findings(p: Project) -> DataFrame:
    """structured_data with errors and warnings as the checks find them."""
    rows = structured_rows(p).withColumns({
        "errors": F.expr("if(type = 'PARSE_ERROR', array('Invalid JSON-LD syntax'), transform(coalesce(lost, array()), x -> concat('Missing required property: ', substring(x, length(rule) + 3))))"),
        "warnings": F.expr("if(type = 'PARSE_ERROR', array(), transform(coalesce(wanted, array()), x -> concat('Missing recommended property: ', substring(x, length(rule) + 3))))"),
    })
    return schema.ensure_columns(rows, "structured_data")


@check("Structured data", sd_parse_error="high", sd_missing_required="high", sd_missing_recommended="low", sd_deprecated_type="medium")
def structured(p: Project) -> list[DataFrame]:
    rows = structured_rows(p).where("type <> 'PARSE_ERROR'")
    gather = lambda c: rows.groupBy("page_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", F.col(c).alias("v")))), lambda x: x["v"]))).alias("b")).where("size(b) > 0")
    once = lambda df: df.select("page_id").distinct()
    # only the first type with a rule is looked at, and all deprecated ones have rules
    old = rows.where("rule in ({})".format(", ".join(repr(t) for t in SD_DEPRECATED)))
    old = listed(old, "get(filter(transform(split(type, ','), t -> trim(t)), t -> lower(t) = rule), 0)")
    return [
        emit(once(p["structured_data"].where("type = 'PARSE_ERROR'")), "sd-parse-error", page="page_id"), emit(gather("lost"), "sd-missing-required", "array_join(b, '; ')", "page_id"),
        emit(gather("wanted"), "sd-missing-recommended", "array_join(slice(b, 1, 12), '; ')", "page_id"), emit(old, "sd-deprecated-type", "array_join(b, ', ')", "page_id"),
    ]


@check("Sitemap", sitemap_non200="medium", sitemap_noindex="medium", sitemap_canonicalised="low", sitemap_orphan="medium", sitemap_missing_indexable="low")
def sitemaps(p: Project) -> list[DataFrame]:
    s = p["sitemap_urls"].select("url")
    pages, any_url = p["pages"], s.limit(1).select(F.lit(1).alias("__one"))
    both = s.join(pages, "url", "left")
    listed = pages.where("in_sitemap = 1 and fetched = 1").join(F.broadcast(any_url))
    return [
        emit(both.where("fetched = 1 and status <> 200"), "sitemap-non200", "concat('HTTP ', status)"), emit(listed.where("indexable = 0 and indexability_reason = 'Noindex'"), "sitemap-noindex"),
        emit(listed.where("canonical <> '' and canonical <> url"), "sitemap-canonicalised", "canonical"), emit(both.where("id is null or fetched = 0"), "sitemap-orphan", "url", "null"),
        emit(html_pages(p).where("indexable = 1 and coalesce(in_sitemap, 0) = 0").join(F.broadcast(any_url)), "sitemap-missing-indexable"),
    ]


@check("Rendering", render_failed="medium", render_console_errors="low", render_canonical_mismatch="high", render_title_changed="low", render_robots_changed="high", render_content_delta="info")
def rendering(p: Project) -> list[Rule]:
    shown_page = "good and rendered = 1 and"
    t = lambda c: f"trim(coalesce({c}, ''))"
    shown = lambda c: f"if({t(c)} = '', '(none)', {t(c)})"
    robots = lambda c: f"array_sort(filter(transform(split(lower(coalesce({c}, '')), ','), x -> trim(x)), x -> x <> ''))"
    words = ["coalesce(word_count, 0)", "coalesce(rendered_word_count, 0)"]
    diff = lambda a, b: f"concat('raw=', {shown(a)}, ' rendered=', {shown(b)})"
    return [
        Rule("good and rendered = 2", "render-failed", "render_error"), Rule(f"{shown_page} size(console_errors) > 0", "render-console-errors", "concat(size(console_errors), ' error(s): ', substring(get(console_errors, 0), 1, 200))"),
        Rule(f"{shown_page} {t('canonical')} <> {t('rendered_canonical')}", "render-canonical-mismatch", diff("canonical", "rendered_canonical")), Rule(f"{shown_page} {t('title')} <> {t('rendered_title')}", "render-title-changed", diff("title", "rendered_title")),
        Rule(f"{shown_page} {robots('meta_robots')} <> {robots('rendered_meta_robots')}", "render-robots-changed", diff("meta_robots", "rendered_meta_robots")),
        Rule(f"{shown_page} {words[1]} - {words[0]} > 100 and {words[1]} > 1.5 * {words[0]}", "render-content-delta", f"concat({words[0]}, ' raw vs ', {words[1]}, ' rendered words')"),
    ]


@check("Accessibility", a11y_critical="high", a11y_serious="medium", a11y_minor="low")
def accessibility(p: Project) -> list[Rule]:
    n = lambda *i: "size(filter(a11y_violations, v -> v.impact in ({})))".format(", ".join(repr(x) for x in i))
    seen, critical, serious, minor = "good and rendered = 1 and a11y_violations is not null and", n("critical"), n("serious"), n("moderate", "minor")
    return [
        Rule(f"{seen} {critical} > 0", "a11y-critical", f"substring(concat({critical}, ' critical: ', coalesce(try_element_at(filter(a11y_violations, v -> v.impact = 'critical'), -1).help, '')), 1, 250)"),
        Rule(f"{seen} {serious} > 0", "a11y-serious", f"concat({serious}, ' serious violation(s)')"), Rule(f"{seen} {minor} > 0", "a11y-minor", f"concat({minor}, ' moderate/minor violation(s)')"),
    ]


#: Names by which parts of the checks are asked for.
MODULES = {f.__name__: f for f in CHECKS}


def parts(p: Project, modules: Iterable[str] = ()) -> list[list[DataFrame]]:
    """All issues, or those of some modules: what rows decide for themselves in one pass over pages, then for each module a plan for each check that compares rows."""
    rules: list[Rule] = []
    compared: list[list[DataFrame]] = []
    for name, f in MODULES.items():
        if not modules or name in modules:
            got = f(p)
            got = got if isinstance(got, list) else [got]
            rules += [x for x in got if isinstance(x, Rule)]
            compared.append([x for x in got if not isinstance(x, Rule)])
    return ([[ruled(p["pages"], rules)]] if rules else []) + [x for x in compared if x]


def run(p: Project, modules: Iterable[str] = ()) -> DataFrame:
    """The parts as one lazy union."""
    return reduce(DataFrame.unionByName, (x for part in parts(p, modules) for x in part))


def written(p: Project) -> DataFrame:
    """All issues, written one module after the other: each task of a union reports the measures of every plan in it, so the union of all would send the driver their product."""
    with joined_by_key(p.spark):
        return cut_all([reduce(DataFrame.unionByName, x) for x in parts(p)], "issues")
