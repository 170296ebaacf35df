"""Summaries: issues, health, totals and the report's data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checks import REGISTRY, WEIGHTS
from ..project import Project
from .views import H


def registry(p: Project) -> DataFrame:
    return p.spark.createDataFrame([(k, c, s, WEIGHTS[s]) for k, (c, s) in REGISTRY.items()], "check_id string, category string, severity string, weight double")


def issue_summary(p: Project, issues: DataFrame) -> DataFrame:
    n = issues.groupBy("check_id").agg(F.count("*").alias("n"))
    out = n.join(F.broadcast(registry(p)), "check_id", "left")
    return out.select("check_id", F.coalesce("category", F.lit("Other")).alias("category"), F.coalesce("severity", F.lit("low")).alias("severity"), F.coalesce("weight", F.lit(WEIGHTS["low"])).alias("weight"), "n").orderBy(F.desc("weight"), F.desc("n"), "check_id")


def category_health(p: Project, issues: DataFrame) -> DataFrame:
    pages = p["pages"].agg(F.greatest(F.lit(1), F.count_if(F.expr(H))).alias("pages"))
    per = issue_summary(p, issues).groupBy("category").agg(F.sum(F.col("n") * F.col("weight")).alias("penalty"), F.sum("n").alias("issues"))
    return per.join(F.broadcast(pages)).select("category", "issues", F.greatest(F.lit(0), F.floor(100 - F.col("penalty") / F.col("pages") * 100 + 0.5)).cast("long").alias("score"))


def site_health(p: Project, issues: DataFrame) -> DataFrame:
    """The rounded mean of the categories' scores."""
    return category_health(p, issues).agg(F.floor(F.avg("score") + 0.5).cast("long").alias("score"))


def totals(p: Project) -> DataFrame:
    return p["pages"].where("fetched >= 1").agg(F.count("*").alias("pages"), F.count_if(F.expr("is_internal = 1")).alias("internal"), F.count_if(F.expr("is_internal = 0")).alias("external"), F.count_if(F.expr("indexable = 1")).alias("indexable"))


def status_buckets(p: Project) -> DataFrame:
    kinds = {"2xx": "status between 200 and 299", "3xx": "status between 300 and 399", "4xx": "status between 400 and 499", "5xx": "status >= 500", "no response": "fetched = 2", "blocked": "fetched = 3"}
    one = p["pages"].where("fetched >= 1 and is_internal = 1").agg(*[F.count_if(F.expr(k)).alias(f"c{i}") for i, k in enumerate(kinds.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("bucket"), F.col(f"c{i}").alias("n")) for i, k in enumerate(kinds)])).alias("x")).select("x.*").where("n > 0")


def worst_pages(p: Project, issues: DataFrame) -> DataFrame:
    """The 30 pages with most issues, of them the 10 with the largest sum of weights."""
    weighed = issues.where("page_id is not null").join(F.broadcast(registry(p)).select("check_id", "weight"), "check_id", "left")
    per = weighed.groupBy("page_id").agg(F.count("*").alias("issues"), F.sum(F.coalesce("weight", F.lit(0.4))).alias("weight")).orderBy(F.desc("issues"), "page_id").limit(30)
    ten = per.orderBy(F.desc("weight"), F.desc("issues"), "page_id").limit(10)
    return p["pages"].select(F.col("id").alias("page_id"), "url").join(F.broadcast(ten), "page_id").select("page_id", "issues", "weight", "url")


def segments(p: Project) -> DataFrame:
    return p["pages"].where("segment is not null").groupBy("segment").agg(F.count("*").alias("pages"), F.count_if(F.expr("indexable = 1")).alias("indexable")).orderBy(F.desc("pages"), "segment")


def average_response(p: Project) -> DataFrame:
    return p["pages"].where("is_internal = 1 and fetched = 1").agg(F.floor(F.avg("response_ms") + 0.5).cast("long").alias("avg_ms"))


def psi_selection(p: Project, n: int = 10) -> DataFrame:
    from .views import counts, with_counts

    df = with_counts(p["pages"].where(H), counts(p["links"], "dst_id", "inlinks"), "inlinks")
    return df.orderBy(F.desc("inlinks"), F.col("depth").asc_nulls_last(), "id").limit(n).select("id", "url", "inlinks", "depth")
