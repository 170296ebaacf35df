"""A project made from stored pages (page_id, url, html), with the crawl signals that the table lacks filled in by fixed arithmetic on the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import DESC_PX, TITLE_PX, pixels
from ..project import Config, Project


def pages(raw: DataFrame) -> DataFrame:
    base = raw.select(F.col("page_id").alias("id"), F.regexp_replace("url", "#.*$", "").alias("url"), "html")
    df = base.withColumns({
        "title": F.regexp_extract("html", "<title>([^<]*)</title>", 1), "heading": F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), "is_internal": F.lit(1),
        "fetched": F.expr("case id % 50 when 17 then 2 when 19 then 3 else 1 end"), "depth": F.expr("cast(id % 6 as int)"), "content_type": F.lit("text/html"), "in_sitemap": F.expr("if(id % 3 = 0, 1, 0)"),
    })
    df = df.withColumn("status", F.expr("case when fetched <> 1 then null else case id % 20 when 3 then 404 when 7 then 301 when 11 then 302 when 13 then 500 else 200 end end"))
    # what a redirect points at is the page four ids on: a shift of the key and an equi-join
    target = base.select((F.col("id") - 4).alias("t_id"), F.col("url").alias("redirect_target"))
    df = df.join(target, (F.col("id") == F.col("t_id")) & F.col("status").between(300, 399), "left").drop("t_id")
    df = df.withColumns({"indexable": F.expr("if(status = 200 and fetched = 1, 1, 0)"), "title_px": pixels(F.col("title"), TITLE_PX), "title_count": F.lit(1), "h1": F.array("heading"), "content_hash": F.sha1("html"), "response_ms": F.expr("cast(id * 37 % 900 as int)")})
    visible = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), "<[^>]+>", " ")
    return df.withColumn("word_count", F.size(F.filter(F.split(visible, r"\s+"), lambda w: w != "")))


def links(pages_: DataFrame) -> DataFrame:
    found = pages_.select(F.col("id").alias("src_id"), F.regexp_extract("url", r"^(https?://[^/?#]+)", 1).alias("origin"), F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("at", "href"))
    to = pages_.groupBy(F.col("url").alias("t_url")).agg(F.min("id").alias("dst_id"))
    found = found.withColumn("dst_url", F.concat("origin", "href"))
    return found.join(to, found["dst_url"] == to["t_url"], "left").select((F.col("src_id") * 1000 + F.col("at")).alias("id"), "src_id", "dst_url", "dst_id", F.lit("ahref").alias("link_type"), F.lit(1).alias("is_internal"), F.lit(1).alias("follow"), F.lit(0).alias("from_render"))


def project(spark: SparkSession, sf_dir: str, config: Config = Config()) -> Project:
    raw = pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    gone = raw.where("id % 25 = 0").select(F.concat("url", F.lit("-gone")).alias("url"))
    site = raw.where("id % 3 = 0").select("url").union(gone).withColumns({"sitemap": F.lit("sitemap.xml")})
    gsc = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("impressions"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    gsc = gsc.join(raw.select("id", "url"), "id", "left").select(F.coalesce("url", F.concat(F.lit("https://orphan.example/"), F.col("id").cast("string"))).alias("url"), F.col("clicks").cast("int").alias("clicks"), F.col("impressions").cast("int").alias("impressions"))
    tables = {"pages": raw, "links": links(raw), "sitemap_urls": site, "api_gsc": gsc}
    return Project(spark, {k: schema.ensure_columns(v, k) for k, v in tables.items()}, config)
