"""Sitemaps read recursively from stored responses.

Index files name further files, which are read level by level: each level is a
join of the urls asked for with the stored responses and one pass that unpacks and
parses their bodies; children that were asked for before are left out by an
anti-join.  A file's place is the path of positions that leads to it, so comparing
length, then path, is comparing by breadth-first order, without any counter that
passes through one task.  Of an url in several files the first in that order stays.

Cases.  A file that is named twice or names itself is read once.  What was not
stored, was answered with another status than 200, or can't be unpacked or is empty
goes to the errors with its reason.  Bodies are gzip by their first two bytes,
whatever their names say; text files hold an absolute url a line.  With a bound on
files, those beyond it in breadth-first order are as if never asked for.  Repeated
responses of one url: one is taken.  No seeds give empty tables.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as urls
from ..store import cut, few_per_batch

PARSED = "sitemap string, path array<long>, kind string, place long, url string, lastmod string"
OPEN = re.compile(r"\s*(?:<\?.*?\?>\s*|<!DOCTYPE[^>]*>\s*)*<([^\s/>]+)", re.S)
#: The entities that XML itself defines.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


@dataclass
class Sitemaps:
    """entries (url, sitemap, lastmod), read (sitemap, level), errors (sitemap, error)."""

    entries: DataFrame
    read: DataFrame
    errors: DataFrame


def unpacked(body: bytes | None) -> str | None:
    """The text of a body; null if there is none or it can't be unpacked."""
    if body is not None and body[:2] == b"\x1f\x8b" and len(body) > 2:
        try:
            whole, rest = b"", body
            while rest[:2] == b"\x1f\x8b":  # members follow one another
                unpack = zlib.decompressobj(31)
                whole += unpack.decompress(rest) + unpack.flush()
                if not unpack.eof:
                    return None
                rest = unpack.unused_data
            body = whole
        except zlib.error:
            return None
    return body.decode("utf-8", "replace") if body else None


def element(text: str, name: str) -> Iterator[str]:
    """The insides of all elements of a name, without regard to what is wrong elsewhere in the file."""
    for m in re.finditer(rf"<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>", text, re.S):
        yield m[1]


def value(block: str, name: str) -> str:
    raw = next(element(block, name), "").strip()
    if raw.startswith("<![CDATA[") and raw.endswith("]]>"):
        return raw[9:-3].strip()
    for a, b in ENTITIES.items():
        raw = raw.replace(a, b)
    return raw.strip()


def parse(text: str) -> list[tuple[str, str, str | None]]:
    """(kind, url, lastmod): kind is child, entry or error."""
    text = text.lstrip("﻿").lstrip()
    if not text.startswith("<"):
        return [("entry", line.strip(), None) for line in text.splitlines() if re.match(r"(?i)https?://", line.strip())]
    if text.count("<!--") > text.count("-->"):
        return [("error", "XML parse error", None)]
    text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    root = OPEN.match(text)
    if not root:
        return [("error", "XML parse error", None)]
    if root[1] == "sitemapindex":
        return [("child", loc, None) for block in element(text, "sitemap") if (loc := value(block, "loc"))]
    if root[1] == "urlset":
        return [("entry", loc, value(block, "lastmod") or None) for block in element(text, "url") if (loc := value(block, "loc"))]
    return []


def stored(spark: SparkSession, folder: str, url: Column) -> DataFrame:
    """Responses (url, status, body) from files in a folder of any store that Spark reads; url: of a file's path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(url.alias("url"), F.lit(200).alias("status"), F.col("content").alias("body"))


def parsed(asked: DataFrame) -> DataFrame:
    """Sitemaps asked for (url, path, status, body, error) to a row for each thing found, and one for the file itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                error = r.error if isinstance(r.error, str) else None
                text = None
                if error is None:
                    text = unpacked(r.body)
                    error = None if text else "Empty or unreadable body"
                found = [("error", error, None)] if error else parse(text)
                failed = bool(found) and found[0][0] == "error"
                rows = [(r.url, r.path, "error", 0, found[0][1], None)] if failed else [(r.url, r.path, "read", 0, None, None), *[(r.url, r.path, kind, at, u, last) for at, (kind, u, last) in enumerate(found)]]
                # a file's rows at a time
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    return asked.select("url", "path", "body", "error").mapInPandas(run, PARSED)


def crawl(seeds: DataFrame, files: DataFrame, most: int | None = None) -> Sitemaps:
    """seeds: url and place, their order; files: url, status, body, and error where a request failed; most: how many files are read at most."""
    spark = seeds.sparkSession
    files = files.select("url", "status", "body", F.col("error") if "error" in files.columns else F.lit(None).cast("string").alias("error"))
    frontier = cut(seeds.groupBy("url").agg(F.array(F.min("place").cast("long")).alias("path")), "frontier")
    seen, levels, done = frontier.select("url"), [], 0
    reason = F.expr("case when error is not null then error when status is null then 'Not stored' when status <> 200 then concat('HTTP ', status) end")
    while not frontier.isEmpty():
        asked = frontier.join(files.dropDuplicates(["url"]), "url", "left").withColumn("error", reason)
        with few_per_batch(spark):
            level = cut(parsed(asked), "sitemaps")
        if most is not None:
            good = level.where("kind = 'read'").select("path").orderBy("path").limit(most - done).collect()
            done += len(good)
            if done == most:
                level = level.where(F.col("path") <= F.lit([int(x) for x in good[-1].path]))
        levels.append(level)
        if done == most:
            break
        children = level.where("kind = 'child'").groupBy("url").agg(F.min(F.concat("path", F.array("place"))).alias("path"))
        frontier = cut(children.join(seen, "url", "left_anti"), "frontier")
        seen = cut(seen.union(frontier.select("url")), "seen")
    found = reduce(DataFrame.unionAll, levels) if levels else spark.createDataFrame([], PARSED)
    first = F.min(F.struct(F.size("path").alias("level"), "path", "place", "sitemap", "lastmod")).alias("f")
    entries = found.where("kind = 'entry'").groupBy("url").agg(first).select("url", "f.sitemap", "f.lastmod")
    return Sitemaps(entries, found.where("kind = 'read'").select("sitemap", F.size("path").alias("level")), found.where("kind = 'error'").select("sitemap", F.col("url").alias("error")))


def listed(entries: DataFrame, policy: str = "crawl", names: tuple[str, ...] = ()) -> DataFrame:
    """entries as rows of sitemap_urls: urls written as crawled pages are stored, each once a sitemap, with an id."""
    whole = F.coalesce(urls.normalized(F.col("url")), F.col("url"))
    return entries.withColumn("url", urls.parameters(whole, policy, names)).groupBy("url", "sitemap").agg(F.max("lastmod").alias("lastmod")).withColumn("id", F.xxhash64("url", "sitemap"))
