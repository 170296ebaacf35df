"""robots.txt of many origins as a table of rules, applied to all urls by joins.

A rule can only match a path that begins with the rule's literal part.  So a path
is cut to the lengths that literal parts of its origin have, and origin and
beginning are joined with the rules: no url meets a rule that its beginning rules
out, and regular expressions run only for rules with wildcards.  The longest
matching rule wins, of equally long ones an allowing one.

Cases.  An origin without a stored file, with another status than 200 or with an
empty body allows all.  Groups for the agent stand before groups for all, even if
they are empty.  Of several files of an origin one is taken.  Urls that are no http
urls are not blocked.  Null urls stay, not blocked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import robots

RULES = "origin string, allow int, rule string, literal string, pattern string"


def origin_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Path and query, as rules are written."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def rules(files: DataFrame, agent: str) -> DataFrame:
    """files (origin, status, body as text) to the rules that hold for an agent, each once an origin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for origin, body in zip(batch["origin"], batch["body"], strict=True):
                for allow, rule in {(a, robots.written(r)) for a, r in robots.rules_for(robots.groups(body), agent)}:
                    rows.append((origin, int(allow), rule, robots.literal(rule), robots.pattern(rule)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RULES.split(", ")])

    good = files.where("status = 200 and body <> ''").select(F.lower("origin").alias("origin"), "body").dropDuplicates(["origin"])
    return good.mapInPandas(run, RULES)


def blocked(pages: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """id, url, rule (the one that decides, null without any) and blocked, 0 or 1, of pages (id, url)."""
    held = rules(files, agent)
    lengths = held.groupBy("origin").agg(F.collect_set(F.length("literal")).alias("lengths"))
    rows = pages.select("id", "url").withColumns({"origin": origin_of(F.col("url")), "path": path_of(F.col("url"))})
    begins = rows.join(lengths, "origin").select("id", "url", "origin", "path", F.explode(F.expr("filter(lengths, n -> n <= length(path))")).alias("n"))
    begins = begins.withColumn("literal", F.expr("substring(path, 1, n)"))
    hits = begins.join(held, ["origin", "literal"]).where("pattern is null or path rlike pattern")
    best = hits.groupBy("id", "url").agg(F.max(F.struct(F.length("rule").alias("size"), "allow", "rule")).alias("best"))
    out = rows.select("id", "url").join(best, ["id", "url"], "left")
    return out.select("id", "url", F.col("best.rule").alias("rule"), F.coalesce(1 - F.col("best.allow"), F.lit(0)).alias("blocked"))
