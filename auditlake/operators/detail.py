"""All that is known of one page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.views import html_pages
from ..plans.views import of_page as is_of
from ..project import Project
from . import near_duplicates

#: Rows shown of each list.
MOST = {"inlinks": 1000, "outlinks": 1000, "images": 500, "duplicates": 200, "near_duplicates": 200}
SIMILAR = r"^(\d+)% similar to (.+)$"


def page(p: Project, page_id: int) -> dict[str, DataFrame]:
    """Named tables of a page: its row, links both ways with the other page's state, images, alternates, structured data, issues, extractions, search hits, signals of the services, and its exact and near duplicates.

    Each is a filter on the page's id or url that reaches the scan; lists are cut at MOST rows by id."""
    own = p["pages"].where(F.col("id") == page_id)
    url = own.select("url")
    state = p["pages"].select(F.col("id").alias("o_id"), F.col("url").alias("o_url"), "status", "indexable")

    def of_page(name: str, key: str = "page_id") -> DataFrame:
        return p[name].where(F.col(key) == page_id)

    def first(df: DataFrame, name: str, by: str = "id") -> DataFrame:
        return df.orderBy(by).limit(MOST[name])

    inlinks = of_page("links", "dst_id").join(state, F.col("src_id") == F.col("o_id")).select("id", F.col("o_url").alias("source"), "anchor", "rel", "follow", "status")
    outlinks = of_page("links", "src_id").join(state, F.col("dst_id") == F.col("o_id"), "left").select("id", "dst_url", "anchor", "rel", "follow", "is_internal", "from_render", "status")
    images = of_page("image_refs").join(p["images"].select(F.col("id").alias("image_id"), "src", "bytes", "status"), "image_id").select("id", "src", "alt", "has_dimensions", "loading", "bytes", "status")
    alike = html_pages(p).join(own.select("content_hash"), "content_hash", "left_semi")
    copies = near_duplicates.exact(alike).where(F.col("page_id") == page_id)
    near = p["issues"].where("check_id = 'content-near-duplicate'").select("page_id", F.regexp_extract("detail", SIMILAR, 1).cast("int").alias("similarity"), F.regexp_extract("detail", SIMILAR, 2).alias("partner_url"))
    pages = state.select("o_id", "o_url")
    there = near.where(F.col("page_id") == page_id).join(pages, F.col("partner_url") == F.col("o_url")).select(F.col("o_id").alias("partner_id"), "partner_url", "similarity")
    back = near.join(url, F.col("partner_url") == F.col("url"), "left_semi").join(pages, F.col("page_id") == F.col("o_id")).select(F.col("page_id").alias("partner_id"), F.col("o_url").alias("partner_url"), "similarity")
    # an exact copy is shown as such only
    both = there.unionByName(back).groupBy("partner_id", "partner_url").agg(F.max("similarity").alias("similarity")).where(F.col("partner_id") != page_id).join(copies.select("partner_id"), "partner_id", "left_anti")
    return {
        "page": own, "inlinks": first(inlinks, "inlinks"), "outlinks": first(outlinks, "outlinks"), "images": first(images, "images"), "hreflang": of_page("hreflang").orderBy("id"), "structured_data": of_page("structured_data").orderBy("id"), "issues": of_page("issues"),
        "extractions": of_page("extractions"), "search_hits": of_page("search_hits"), **{k: p[k].join(url, "url", "left_semi").where(is_of("page_id", F.lit(page_id))) for k in ("api_gsc", "api_ga4", "api_psi", "backlinks")}, "sitemaps": p["sitemap_urls"].join(url, "url", "left_semi"),
        "duplicates": first(copies, "duplicates", "partner_id"), "near_duplicates": first(both, "near_duplicates", "partner_id"),
    }
