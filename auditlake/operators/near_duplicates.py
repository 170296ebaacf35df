"""Near duplicates by banded simhash: pages that share one of four 16-bit bands are compared.

Only distinct simhashes are compared, each with the first page of it and the
first of other content.  A band value that more than BUCKET of them share is
split by the other 48 bits, in a way that loses no pair within the distance."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import cut

BUCKET = 2000
#: Above this distance parts of the other 48 bits are too short to split by.
SPLIT_MOST = 10


def parts(most: int) -> Column:
    """Keys of a row of a large bucket: of most + 2 parts of the other 48 bits, any two simhashes within the distance have two in common."""
    n = most + 2
    at = [48 * i // n for i in range(n + 1)]
    rest = "(shiftrightunsigned(s, 16 * (band + 1)) | shiftleft(s, 64 - 16 * (band + 1)))"
    part = [f"(shiftrightunsigned({rest}, {a}) & {(1 << (z - a)) - 1}L)" for a, z in zip(at, at[1:], strict=False)]
    return F.expr("array(" + ", ".join(f"{k << 32}L + shiftleft({part[i]}, 16) + {part[j]}" for k, (i, j) in enumerate(combinations(range(n), 2))) + ")")


def prepared(pages: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """Rows (id, url, s, content_hash), and the largest distance."""
    kind = pages.schema["simhash"].dataType.simpleString()
    value = F.col("simhash") if kind == "bigint" else F.conv("simhash", 16, -10).cast("long")
    return pages.select("id", "url", value.alias("s"), "content_hash").where("s is not null"), max(1, math.floor((1 - threshold) * 64))


def near(rows: DataFrame, most: int) -> DataFrame:
    """s, t, band, first, distance: simhashes, also one with itself, that share a band, in both orders."""
    band = F.explode(F.expr("transform(sequence(0, 3), i -> named_struct('band', i, 'v', shiftrightunsigned(s, 16 * i) & 65535))")).alias("k")
    banded = rows.groupBy("s").agg(F.min("id").alias("id")).select("s", "id", band).select("s", "id", "k.band", "k.v")
    sizes = banded.groupBy("band", "v").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    one = F.array(F.lit(-1).cast("long"))
    key = F.when(F.col("n") > BUCKET, parts(most)).otherwise(one) if most <= SPLIT_MOST else one
    kept = banded.join(sizes, ["band", "v"]).select("band", "v", "first", "s", F.explode(key).alias("key"))
    both = kept.join(kept.select("band", "v", "key", F.col("s").alias("t")), ["band", "v", "key"]).withColumn("distance", F.bit_count(F.col("s").bitwiseXOR(F.col("t"))))
    return both.where(F.col("distance") <= most).select("s", "t", "band", "first", "distance").distinct()


def pairs(pages: DataFrame, threshold: float) -> DataFrame:
    """a < b with their distance, from rows (id, url, simhash long or hex, content_hash)."""
    rows, most = prepared(pages, threshold)
    a = rows.select("s", F.col("id").alias("a"), F.col("url").alias("a_url"), F.col("content_hash").alias("ha"))
    b = rows.select(F.col("s").alias("t"), F.col("id").alias("b"), F.col("url").alias("b_url"), F.col("content_hash").alias("hb"))
    return near(rows, most).join(a, "s").join(b, "t").where("a < b and not ha <=> hb").select("band", "first", "a", "b", "a_url", "b_url", "distance")


def two_least(rows: DataFrame, *order: str) -> DataFrame:
    """s, x, y: of each s the least row by order, and the least of those with another content_hash (or null)."""
    r = rows.select("s", F.struct(*order).alias("r"))
    x = r.groupBy("s").agg(F.min("r").alias("x"))
    y = r.join(x, "s").where("not r.content_hash <=> x.content_hash").groupBy("s").agg(F.min("r").alias("y"))
    return x.join(y, "s", "left")


def exact(pages: DataFrame, most: int | None = None) -> DataFrame:
    """page_id, partner_id, partner_url: other pages with the same content_hash, the first ``most`` by id if asked for."""
    other = pages.select(F.col("id").alias("partner_id"), F.col("url").alias("partner_url"), "content_hash")
    both = pages.select(F.col("id").alias("page_id"), "content_hash").join(other, "content_hash").where("page_id <> partner_id").drop("content_hash")
    if most is None:
        return both
    return both.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("partner_id"))).where(f"r <= {most}").drop("r")


def first_matches(pages: DataFrame, threshold: float = 0.9) -> DataFrame:
    """page_id, partner_id, partner_url, similarity (percent): each page's first match, in order of band value's first page, band, a, b.

    Within a band value that is the partner with the smallest id."""
    rows, most = prepared(pages, threshold)
    rows = cut(rows, "simhashes")  # read many times
    firsts = two_least(rows, "id", "url", "content_hash").select(F.col("s").alias("t"), F.explode(F.array("x", "y")).alias("p")).where("p is not null")
    found = cut(near(rows, most).join(firsts, "t").select("s", "first", "band", "distance", "p.*"), "near_duplicates")
    best = two_least(found, "first", "band", "id", "url", "content_hash", "distance")
    match = F.expr("if(content_hash <=> x.content_hash, y, x)").alias("m")
    similarity = F.floor((1 - F.col("m.distance") / 64) * 100 + 0.5).cast("int")
    got = rows.join(best, "s").select(F.col("id").alias("page_id"), match).where("m is not null")
    return got.select("page_id", F.col("m.id").alias("partner_id"), F.col("m.url").alias("partner_url"), similarity.alias("similarity"))
