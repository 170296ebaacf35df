"""Link graph, crawl tree and crawl frontier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import url as urls
from ..store import cut
from ..plans.views import counts, with_counts
from ..project import Project
from .segments import usable


def nodes(p: Project, most: int = 1500) -> DataFrame:
    """The report's first nodes: shallow pages first, then the most linked; a top-k, which Spark keeps per task."""
    df = with_counts(p["pages"].where("is_internal = 1 and fetched = 1"), counts(p["links"], "dst_id", "inlinks"), "inlinks")
    return df.orderBy(F.col("depth").asc_nulls_last(), F.col("inlinks").desc(), "id").limit(most).select("id", "url", "depth", "inlinks", "crawl_source")


def edges(p: Project, kept: DataFrame, most: int | None = None, inside: bool = True) -> DataFrame:
    """Distinct links between two of the pages kept, all or the first ``most`` of them; inside: only those marked internal."""
    ids = kept.select("id")
    e = p["links"].where("dst_id is not null and src_id <> dst_id" + " and is_internal = 1" * inside).select("src_id", "dst_id")
    e = e.join(ids, e["src_id"] == ids["id"], "left_semi").join(ids, e["dst_id"] == ids["id"], "left_semi").distinct()
    return e if most is None else e.orderBy("src_id", "dst_id").limit(most)


def tree(pages: DataFrame) -> DataFrame:
    """id, parent_id: the page it was found on, if that is in the set and another, else null (the root).  If any way up never ends, all pages hang on the root.

    Ways up are followed by pointer jumping: each round doubles the length."""
    parent = pages.groupBy(F.col("url").alias("p_url")).agg(F.min("id").alias("up"))
    df = pages.select("id", "url", "crawl_source").join(parent, (F.col("crawl_source") == F.col("p_url")) & (F.col("crawl_source") != F.col("url")), "left").select("id", F.col("up").alias("parent_id"))
    df = cut(df, "tree")
    jump, before, rounds = df, df.count() + 1, 0
    while True:
        open_ends = jump.where("parent_id is not null")
        n = open_ends.count()
        if n == 0:
            return df
        if n == before:
            # a round that ends no way may still shorten one: ways of n pages end within log n rounds
            rounds += 1
            if 1 << rounds > n:
                return df.withColumn("parent_id", F.lit(None).cast("long"))
        else:
            rounds = 0
        before = n
        far = jump.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("far"))
        jump = cut(jump.join(far, "parent_id", "left").select("id", F.col("far").alias("parent_id")), "tree")


@dataclass(frozen=True)
class Scope:
    """Which discovered links a crawl takes: what it does with queries, patterns of urls, and whether it follows links at all."""

    parameters: str = "crawl"
    names: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    #: In list mode only the urls given are crawled, and where they redirect to.
    list_mode: bool = False
    external: bool = True
    binaries: bool = True


def in_scope(links: DataFrame, scope: Scope) -> DataFrame:
    """links (src_url, dst_url, is_internal, is_redirect) that a crawl takes, internal targets written as it stores them."""
    spark = links.sparkSession
    inside = links.where("is_internal = 1").withColumn("dst_url", urls.parameters(F.col("dst_url"), scope.parameters, scope.names))
    inside = inside.where(urls.in_scope(F.col("dst_url"), scope.include, scope.exclude, lambda p: usable(spark, p)))
    if not scope.binaries:
        inside = inside.where(~urls.looks_binary(F.col("dst_url")))
    if scope.list_mode:
        inside = inside.where("is_redirect = 1")
    return inside.unionByName(links.where("is_internal = 0")) if scope.external else inside


def frontier(seeds: DataFrame, links: DataFrame, max_depth: int, max_urls: int | None = None, follow_nofollow: bool = True, external_depth: int = 0, scope: Scope | None = None) -> DataFrame:
    """url, depth reached from the seeds: one join a level, known urls left out by anti-join, levels written.

    links: src_url, dst_url, and if there follow, is_internal and is_redirect.
    Links marked nofollow are passed over unless followed, redirects are not;
    external pages are reached but not left; a redirect's target keeps its depth;
    with max_urls the first ones by depth, then url, are kept, and levels beyond them
    are not asked for.  A scope decides which links count."""
    have = set(links.columns)
    flag = lambda c, other: F.col(c) if c in have else F.lit(other)
    step = links.where("follow = 1" + (" or is_redirect = 1" if "is_redirect" in have else "")) if "follow" in have and not follow_nofollow else links
    if scope is not None:
        step = in_scope(step.select("src_url", "dst_url", flag("is_internal", 1).alias("is_internal"), flag("is_redirect", 0).alias("is_redirect")), scope)
        have = set(step.columns)
    step = cut(step.groupBy("src_url", "dst_url").agg(F.max(flag("is_internal", 1)).alias("inside"), F.min(flag("is_redirect", 0)).alias("moved")), "frontier_links")
    seen = cut(seeds.select("url", F.lit(0).alias("depth"), F.lit(1).alias("inside")).distinct(), "frontier")
    level = seen
    while True:
        near = level.where("inside = 1").join(step, level["url"] == step["src_url"])
        near = near.select(F.col("dst_url").alias("url"), (F.col("depth") + 1 - F.col("moved")).cast("int").alias("depth"), step["inside"])
        near = near.where((F.col("depth") <= max_depth) & ((F.col("inside") == 1) | (F.col("depth") <= max(external_depth, 1))))
        level = cut(near.groupBy("url").agg(F.min("depth").alias("depth"), F.max("inside").alias("inside")).join(seen, "url", "left_anti"), "frontier")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        # a redirect keeps its depth, so only the depths below the deepest are complete
        if max_urls and seen.where(F.col("depth") < level.agg(F.min("depth")).first()[0]).count() >= max_urls:
            break
    out = seen.select("url", "depth")
    return out.orderBy("depth", "url").limit(max_urls) if max_urls else out
