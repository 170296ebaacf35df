"""Exports: CSV with a formula guard, XML sitemaps, redirect files.  All are distributed text writes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..project import Project
from ..store import cut, drop, file_system, names_in, numbered, write_once
from . import views
from .reports import issue_summary
from .views import H

#: Pages that may be listed: indexable, and no copies of others.
OWN = "indexable = 1 and (canonical is null or canonical = '' or canonical = url)"

PER_FILE, IMAGES_PER_PAGE = 45_000, 1000


def csv_cell(c: Column, guard: bool = True) -> Column:
    """Quoted where needed; cells that a spreadsheet would run get a quote mark in front, plain negative numbers don't."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    if guard:
        text = F.when(text.rlike(r"^[=+@\t\r]") | (text.startswith("-") & ~text.rlike(r"^-\d+(\.\d+)?$")), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(text.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, guard: bool = True) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`"), guard) for c in df.columns]).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """Parts of lines without a header, for tables of any size."""
    csv_lines(df).write.option("lineSep", "\r\n").text(path)


def labels(columns: Iterable[str]) -> list[str]:
    """Column names as headings: status_text to Status Text."""
    return [c.replace("_", " ").title() for c in columns]


def ordered_text(lines: DataFrame, order: list[str], folder: str, head: str | None = None, sep: str = "\n") -> list[str]:
    """Lines (value, and the columns of their order) as parts in a folder: one after the other, by name, they are the file.

    Rows are dealt by ranges and written where they are sorted; the head is the first
    row of the first range.  ``_manifest.json`` names the parts in their order.  Gives
    the names."""
    spark = lines.sparkSession
    rows = lines.select(F.lit(1).alias("__at"), *order, "value")
    if head is not None:
        first = spark.createDataFrame([(0, head)], "__at int, value string")
        rows = first.unionByName(rows, allowMissingColumns=True)
    by = [F.col("__at"), *[F.col(c).asc_nulls_last() for c in order]]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).select("value").write.option("lineSep", sep).text(folder)
    names = sorted((n for n in names_in(spark, folder) if n.startswith("part-")), key=lambda n: int(n.split("-")[1].split(".")[0]))
    write_once(spark, f"{folder}/_manifest.json", json.dumps({"parts": names}))
    return names


def csv_file(p: Project, view: str, folder: str, filter_id: str | None = None, guard: bool = False) -> list[str]:
    """A CSV file of a view for a spreadsheet, as ordered parts: byte order mark, headings, rows by id."""
    rows = views.rows(p, view, filter_id)
    order = [c for c in ("id", "url", "src") if c in rows.columns]
    columns = views.VIEWS[view].columns
    line = F.concat_ws(",", *[csv_cell(F.col(f"`{c}`"), guard) for c in columns]).alias("value")
    return ordered_text(rows.select(*order, line), order, folder, "﻿" + ",".join(labels(columns)), "\r\n")


def populated(p: Project) -> list[str]:
    """Views that have a row."""
    return [r.view for r in views.overview(p).where("filter is null and n > 0").orderBy("view").collect()]


def csv_folder(p: Project, issues: DataFrame, folder: str) -> list[str]:
    """issues-summary.csv and a file for each populated view, each as ordered parts; gives the names."""
    summary = issue_summary(p, issues).select("check_id", "category", "severity", "n")
    lines = summary.select("check_id", F.concat_ws(",", *[csv_cell(F.col(c)) for c in summary.columns]).alias("value"))
    ordered_text(lines, ["check_id"], f"{folder}/issues-summary.csv", "﻿Check Id,Category,Severity,Count", "\r\n")
    names = populated(p)
    for v in names:
        csv_file(p, v, f"{folder}/{v}.csv")
    return ["issues-summary.csv", *[f"{v}.csv" for v in names]]


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sitemap_entries(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """file (from 1), url, xml of indexable self-canonical pages in order of url, so many a file.

    Urls are dealt by range and ranked within their range; the ranges' sizes,
    one row each, give each range its first rank, so no task sorts all urls."""
    ok = pages.where(H).where(OWN).select("url", "id")
    ranged = cut(ok.repartitionByRange("url", "id").withColumn("p", F.spark_partition_id()), "sitemap")
    before = F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranged.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("url", "id")) - 1
    entry = F.concat(F.lit("<url><loc>"), xml_escape(F.col("url")), F.lit("</loc></url>"))
    ranked = ranged.withColumn("r", rank).join(F.broadcast(sizes), "p").withColumn("r", F.col("base") + F.col("r"))
    return ranked.select((F.floor(F.col("r") / per_file) + 1).alias("file"), "url", entry.alias("xml"))


def sitemap_files(p: Project, base_url: str, folder: str, per_file: int = PER_FILE) -> list[str]:
    """sitemap.xml, or several files and an index of them, and as many for images if there are any; gives the names.

    All files come from one write, a task for each, of rows in order; each is then
    moved to its name.  Only the names pass through the driver."""
    spark, root, space = p.spark, base_url.rstrip("/"), "http://www.sitemaps.org/schemas/sitemap/0.9"
    pages = sitemap_entries(p["pages"], per_file).select("file", "url", F.concat(F.lit("  "), "xml").alias("line"))
    images = image_entries(p["pages"], p["image_refs"], p["images"].where("is_internal = 1"))
    per_page = images.groupBy("url").agg(F.array_join(F.array_sort(F.collect_list("xml")), "").alias("xml"))
    per_page = numbered(per_page, [F.col("url").asc()], "image_pages")
    of_images = per_page.select((F.floor(F.col("place") / per_file) + 1).alias("file"), "url", F.concat(F.lit("  <url><loc>"), xml_escape(F.col("url")), F.lit("</loc>"), "xml", F.lit("</url>")).alias("line"))
    kinds = {"sitemap": (pages, ""), "image-sitemap": (of_images, ' xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"')}
    parts, names = [], []
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<{0} xmlns="' + space + '"{1}>'
    for kind, (rows, more) in kinds.items():
        rows = cut(rows, kind)
        n = rows.agg(F.max("file")).first()[0] or 0
        if not n and kind == "image-sitemap":
            continue
        one = n <= 1
        name = F.lit(f"{kind}.xml") if one else F.concat(F.lit(f"{kind}-"), F.col("file").cast("string"), F.lit(".xml"))
        files = spark.range(1, max(n, 1) + 1).select(F.col("id").alias("file"))
        parts.append(rows.select(name.alias("name"), F.lit(1).alias("at"), "url", "line"))
        ends = F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit(head.format("urlset", more)).alias("line")), F.struct(F.lit(2).alias("at"), F.lit("</urlset>").alias("line"))))
        parts.append(files.select(name.alias("name"), ends.alias("x")).select("name", "x.at", F.lit("").alias("url"), "x.line"))
        own = [f"{kind}.xml"] if one else [f"{kind}-{i}.xml" for i in range(1, n + 1)]
        names += own
        if not one:
            index = [(0, "", head.format("sitemapindex", "")), *[(1, f"{i:09d}", f"  <sitemap><loc>{root}/{x}</loc></sitemap>") for i, x in enumerate(own)], (2, "", "</sitemapindex>")]
            parts.append(spark.createDataFrame([(f"{kind}.xml", *x) for x in index], "name string, at int, url string, line string"))
            names.append(f"{kind}.xml")
    draft = f"{folder}/.draft-{uuid.uuid4().hex}"
    lines = views.union(parts).repartition("name").sortWithinPartitions("name", "at", "url")
    lines.select("name", "line").write.partitionBy("name").text(draft)
    for name in names:
        part = next(n for n in names_in(spark, f"{draft}/name={name}") if n.startswith("part-"))
        fs, at = file_system(spark, f"{draft}/name={name}/{part}")
        fs.rename(at, file_system(spark, f"{folder}/{name}")[1])
    drop(spark, draft)
    return names


def image_entries(pages: DataFrame, refs: DataFrame, images: DataFrame) -> DataFrame:
    ok = pages.where(H).where(OWN).select(F.col("id").alias("page_id"), "url")
    src = refs.join(images.select(F.col("id").alias("image_id"), "src"), "image_id").join(ok, "page_id").groupBy("url", "src").agg(F.min("id").alias("first"))
    w = Window.partitionBy("url").orderBy("first")
    return src.withColumn("r", F.row_number().over(w)).where(f"r <= {IMAGES_PER_PAGE}").select("url", "src", F.concat(F.lit("<image:image><image:loc>"), xml_escape(F.col("src")), F.lit("</image:loc></image:image>")).alias("xml"))


#: How each kind of redirect file begins.
REDIRECT_HEADS = {"htaccess": "# 301 redirect map\n# Review medium-confidence lines; lines without a target need one by hand.\n", "nginx": "# 301 redirect map (server block context)\n", "csv": "source,target"}


def redirect_lines(suggested: DataFrame, kind: str) -> DataFrame:
    """old_url and value, the lines of a redirect file: htaccess, nginx or csv.

    Targets of medium confidence have a line of warning above, urls without a target
    are comments, so that nothing is deployed blindly; the csv file has only targets."""
    path = F.regexp_extract("old_path", r"^([^?]*)", 1)
    if kind == "csv":
        return suggested.where("target is not null").select("old_url", F.concat_ws(",", csv_cell(path, False), csv_cell(F.col("target"), False)).alias("value"))
    made = {"htaccess": F.concat(F.lit("Redirect 301 "), path, F.lit(" "), "target"), "nginx": F.concat(F.lit("location = "), path, F.lit(" { return 301 "), "target", F.lit("; }"))}
    review = F.when(F.col("tier") == "medium", "# REVIEW (medium confidence)\n").otherwise("")
    return suggested.select("old_url", F.coalesce(F.concat(review, made[kind]), F.concat(F.lit("# TODO no target found: "), "old_path")).alias("value"))


def redirect_file(suggested: DataFrame, kind: str, folder: str) -> list[str]:
    """A redirect file as ordered parts, by old url."""
    return ordered_text(redirect_lines(suggested, kind), ["old_url"], folder, REDIRECT_HEADS[kind])
