"""Importers: backlink CSVs, search, analytics and page-speed rows, sitemaps and URL lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Header names of backlink exports, lower-cased; the first that a file has is taken.
ALIASES = {
    "url": ["target url", "url", "page url", "item", "target"],
    "domain_rating": ["domain rating", "dr", "domain authority", "da", "trust flow", "trustflow"],
    "url_rating": ["url rating", "ur", "page authority", "pa", "citation flow", "citationflow"],
    "ref_domains": ["referring domains", "ref domains", "ref. domains", "linking root domains", "refdomains", "ref domain", "referring domain"],
    "backlinks": ["backlinks", "inbound links", "total backlinks", "extbacklinks", "external backlinks"],
}


def provider_of(columns: list[str]) -> str:
    """Whose export a file is, by its header."""
    names = {c.strip().lower() for c in columns}
    if names & {"domain rating", "dr", "url rating", "ur"}:
        return "ahrefs"
    if names & {"domain authority", "da", "page authority", "pa"}:
        return "moz"
    return "majestic" if any("trust flow" in n for n in names) or names & {"trustflow", "citationflow"} else "generic"


def number(c: str):
    """'1,234' to 1234; blank or no number to null."""
    return F.regexp_replace(F.trim(c), r"[,\s]", "").try_cast("double")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """RFC 4180, embedded line feeds and a byte order mark included; rows of blanks alone are dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.where(F.concat_ws("", *[F.trim(F.col(f"`{c}`")) for c in df.columns]) != "")


def skipped(rows: DataFrame) -> int:
    """Rows of a backlink export without a url."""
    names = {c.strip().lower(): c for c in rows.columns}
    url = next(names[a] for a in ALIASES["url"] if a in names)
    return rows.where(F.coalesce(F.trim(F.col(f"`{url}`")), F.lit("")) == "").count()


def backlinks(rows: DataFrame, provider: str | None = None, order: str | None = None) -> DataFrame:
    """One row a url, the last of the input; order names a column that gives the input's order."""
    names = {c.strip().lower(): c for c in rows.columns}
    pick = {k: next((names[a] for a in v if a in names), None) for k, v in ALIASES.items()}
    if not pick["url"]:
        raise ValueError("no column with urls")
    get = lambda k: number(f"`{pick[k]}`") if pick[k] else F.lit(None).cast("double")
    out = rows.select(F.trim(F.col(f"`{pick['url']}`")).alias("url"), F.lit(provider or provider_of(rows.columns)).alias("provider"), get("domain_rating").alias("domain_rating"), get("url_rating").alias("url_rating"), get("ref_domains").cast("int").alias("ref_domains"), get("backlinks").cast("int").alias("backlinks"), (F.col(order) if order else F.monotonically_increasing_id()).alias("__at"))
    last = Window.partitionBy("url").orderBy(F.desc("__at"))
    return out.where("url <> ''").withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r", "__at")


def url_list(rows: DataFrame) -> DataFrame:
    """Every cell that is an http(s) URL, once."""
    cells = rows.select(F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in rows.columns])).alias("url")).select(F.trim("url").alias("url"))
    return cells.where(F.col("url").rlike("(?i)^https?://")).distinct()


def ga4(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows (path, sessions, engaged, rate, conv, users) merged per page: slash variants add up, rates weigh by sessions."""
    key = lambda c: F.when(c == "/", c).otherwise(F.regexp_replace(c, "/$", ""))
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    first = pages.where("is_internal = 1 and fetched = 1").withColumn("k", key(F.when(path == "", "/").otherwise(path))).groupBy("k").agg(F.min_by("url", "id").alias("url"))
    merged = rows.withColumn("k", key(F.col("path"))).groupBy("k").agg(F.sum("sessions").cast("int").alias("sessions"), F.sum("engaged").cast("int").alias("engaged_sessions"), (F.floor(F.try_divide(F.sum(F.col("rate") * F.col("sessions")), F.sum("sessions")) * 1000 + 0.5) / 1000).alias("engagement_rate"), F.sum("conv").alias("conversions"), F.sum("users").cast("int").alias("total_users"))
    return merged.join(first, "k").drop("k")


def gsc(rows: DataFrame) -> DataFrame:
    """ctr as a percentage with two places, position with one."""
    return rows.select("url", F.col("clicks").cast("int"), F.col("impressions").cast("int"), (F.floor(F.col("ctr") * 10000 + 0.5) / 100).alias("ctr"), (F.floor(F.col("position") * 10 + 0.5) / 10).alias("position"))


def psi(rows: DataFrame) -> DataFrame:
    """rows (url, strategy, json) of page-speed responses."""
    score = lambda k: F.floor(F.get_json_object("json", f"$.lighthouseResult.categories['{k}'].score").cast("double") * 100 + 0.5).cast("int")
    lab = lambda k: F.get_json_object("json", f"$.lighthouseResult.audits['{k}'].numericValue").cast("double")
    crux = lambda k: F.get_json_object("json", f"$.loadingExperience.metrics.{k}.percentile").cast("double")
    return rows.select("url", "strategy", score("performance").alias("performance"), score("seo").alias("seo"), score("accessibility").alias("accessibility"), score("best-practices").alias("best_practices"), lab("largest-contentful-paint").alias("lcp_ms"), lab("interaction-to-next-paint").alias("inp_ms"), lab("cumulative-layout-shift").alias("cls"), crux("LARGEST_CONTENTFUL_PAINT_MS").alias("field_lcp_ms"), crux("INTERACTION_TO_NEXT_PAINT").alias("field_inp_ms"), (crux("CUMULATIVE_LAYOUT_SHIFT_SCORE") / 100).alias("field_cls"))


def sitemap_rows(files: DataFrame) -> DataFrame:
    """files (sitemap, body) to url, sitemap, lastmod: XML url sets or plain text, each url once a file."""
    xml = F.col("body").rlike(r"(?i)<(urlset|sitemapindex)\b")
    blocks = F.explode(F.when(xml, F.regexp_extract_all("body", F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), F.lit(1))).otherwise(F.filter(F.split("body", r"\r?\n"), lambda u: F.trim(u).rlike("^https?://")))).alias("b")
    got = files.select("sitemap", xml.alias("x"), blocks)
    unescape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    url = F.when(F.col("x"), unescape(F.trim(F.regexp_extract("b", r"(?is)<loc>(.*?)</loc>", 1)))).otherwise(F.trim("b"))
    last = F.when(F.col("x"), F.nullif(F.trim(F.regexp_extract("b", r"(?is)<lastmod>(.*?)</lastmod>", 1)), F.lit("")))
    return got.select(url.alias("url"), "sitemap", last.alias("lastmod")).where("url <> ''").groupBy("url", "sitemap").agg(F.max("lastmod").alias("lastmod"))


def sitemap_children(files: DataFrame) -> DataFrame:
    """URLs of further sitemap files that index files name."""
    return files.select(F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<sitemap\b[^>]*>.*?<loc>\s*(.*?)\s*</loc>.*?</sitemap>"), F.lit(1))).alias("sitemap")).distinct()
