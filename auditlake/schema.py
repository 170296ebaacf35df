"""Tables of a project, as typed Spark schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = "is_internal fetched status depth size response_ms title_px title_count meta_description_px meta_description_count word_count indexable in_sitemap rendered rendered_word_count robots_blocked"
_TEXTS = "status_text error content_type redirect_target title meta_description meta_robots x_robots canonical canonical_header viewport indexability_reason content_hash simhash spa_framework crawl_source render_error rendered_title rendered_meta_description rendered_canonical rendered_meta_robots rel_next rel_prev segment"
_PAGES = "id long, url string, " + ", ".join(f"{c} int" for c in _INTS.split()) + ", text_ratio double, " + ", ".join(f"{c} string" for c in _TEXTS.split())
_PAGES += ", redirect_chain array<struct<url:string,status:int>>, canonical_all array<string>, h1 array<string>, h2 array<string>, rendered_h1 array<string>, headers map<string,string>, og map<string,string>, console_errors array<string>, a11y_violations array<struct<id:string,impact:string,help:string,nodes:int,sample:string>>"

#: page_id of the imported tables and of sitemap entries: the page that a row is of; null where only its url is known, so of every page that has it.
DDL = {
    "meta": "key string, value string",
    "pages": _PAGES,
    "html": "page_id long, raw_html string, rendered_html string",
    "links": "id long, src_id long, dst_url string, dst_id long, anchor string, rel string, follow int, link_type string, is_internal int, from_render int",
    "images": "id long, src string, is_internal int, bytes long, status int, content_type string, checked int",
    "image_refs": "id long, page_id long, image_id long, alt string, has_dimensions int, loading string",
    "hreflang": "id long, page_id long, lang string, href string, source string",
    "structured_data": "id long, page_id long, format string, type string, json string, errors array<string>, warnings array<string>",
    "issues": "check_id string, page_id long, detail string",
    "extractions": "id long, page_id long, extractor_id string, value string",
    "search_hits": "id long, page_id long, search_id string, hits int",
    "sitemap_urls": "id long, url string, sitemap string, lastmod string, page_id long",
    "api_gsc": "url string, clicks int, impressions int, ctr double, position double, fetched_at string, page_id long",
    "api_ga4": "url string, sessions int, engaged_sessions int, engagement_rate double, conversions double, total_users int, fetched_at string, page_id long",
    "api_psi": "url string, strategy string, performance int, seo int, accessibility int, best_practices int, lcp_ms double, inp_ms double, cls double, field_lcp_ms double, field_inp_ms double, field_cls double, fetched_at string, page_id long",
    "backlinks": "url string, provider string, domain_rating double, url_rating double, ref_domains int, backlinks int, imported_at string, page_id long",
    "compare_results": "id long, old_url string, old_status int, old_title string, matched_url string, match_type string, new_status int, new_title string, redirect_target string, redirect_ok int, result string, title_changed int, canonical_changed int",
}
#: Columns that were only added, and are null in older projects, need no new version.
SCHEMA_VERSION = 4


def struct(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name]) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(DDL[name])


def ensure_columns(df: DataFrame, name: str) -> DataFrame:
    """df with the table's columns, typed; absent ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(name)])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], DDL[name])
