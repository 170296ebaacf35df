"""Importance resampling towards the distribution of a target corpus.

Texts, with A-Z lowered, are runs of words; features are all runs of one and two
words, each put into one of BUCKETS by its checksum.  A bucket's gain is the
scaled logarithm of its smoothed share in the target over that in the documents.
A document's weight is its features' mean gain; Gumbel noise from a hash of its id
is added, and the highest scores are drawn: a draw without replacement, the same
in every run.

Documents are never exploded for scoring: higher-order functions make each one's
array of buckets, and a fold over that array reads a literal array of gains.  Only
counts are shuffled before the draw: totals by bucket (BUCKETS rows a task at most)
and a histogram of scores.  Scores are whole numbers: a gain lies within 1000 *
ln(2 ** 64) of 0 and the noise between -3132 and 22874, so the histogram that the
driver reads has some 10 ** 5 rows however many documents there are.  Rows below
the histogram's cut are not moved at all; those above it are sorted by ranges, and a
rank is the place in the range plus the rows of the ranges before.

Cases.  Null and empty texts and texts without a word have no features and weight
0.  Rows without an id have no noise: score and rank are null and they are not
counted among the documents to draw from.  Repeated rows each count, each score
alike and each take a rank of their own; rows of one id with equal scores are
ranked in any order.  Other columns are ignored.  An empty table gives an empty
result; an empty target is a target without counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import cut, forget

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z lowered, nothing else; plain ASCII texts take the short way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))


def bucketed(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """docs with n_words and the buckets of all features, repeats included."""

    def bucket(feature: Column) -> Column:
        return F.pmod(F.crc32(feature), F.lit(buckets)).cast("int")

    words = docs.withColumn("__w", F.coalesce(F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), F.lit(0)), F.array().cast("array<string>")))
    sized = words.withColumn("n_words", F.size("__w").cast("long"))
    rest = F.slice("__w", F.lit(2), F.greatest(F.size("__w") - 1, F.lit(0)))
    pairs = F.zip_with(F.slice("__w", F.lit(1), F.size(rest)), rest, lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    return sized.withColumn("buckets", F.concat(F.transform("__w", bucket), pairs)).drop("__w")


def totals(rows: DataFrame) -> DataFrame:
    """bucket, n: summed up in each task before they are shuffled."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(have: dict[int, int], want: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Each bucket's scaled logarithm of the target's smoothed share over the documents'."""
    s_all, t_all = sum(have.values()), sum(want.values())
    return [math.floor(1000 * math.log((want.get(b, 0) + 1) * float(s_all + buckets) / ((have.get(b, 0) + 1) * float(t_all + buckets)))) for b in range(buckets)]


def weigh(rows: DataFrame, gain: list[int]) -> DataFrame:
    """rows with n_features and weight: the floored mean gain, by a fold over each row's own array."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")  # folded into one literal by the optimiser
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    summed = rows.withColumn("n_features", F.size("buckets").cast("long")).withColumn("__sum", total)
    mean = F.expr("(__sum - pmod(__sum, n_features)) div n_features")
    return summed.withColumn("weight", F.when(F.col("n_features") > 0, mean).otherwise(F.lit(0)).cast("long")).drop("__sum")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, above: int) -> DataFrame:
    """rows with their rank by falling score and rising doc_id, from above + 1: sorted by ranges, places summed over the ranges before."""
    order = [F.desc("score"), F.asc("doc_id"), F.asc("__row")]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    spread = cut(spread, "sorted")
    part, place = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row a range
    sizes = sorted((r.part, r.n) for r in spread.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, at = [], above
    for p, n in sizes:
        starts.append((p, at))
        at += n
    begin = spread.sparkSession.createDataFrame(starts, "part long, begin long")
    joined = spread.withColumn("part", part).join(F.broadcast(begin), "part")
    return joined.withColumn("rank", F.col("begin") + place + 1).drop("part", "begin", "__at", "__row")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank is null where a row isn't drawn.

    Of the rows with at least least_words words, percent hundredths are drawn."""
    rows = cut(bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), buckets).drop("text"), "buckets")
    have = {r.bucket: r.n for r in totals(rows).collect()}
    want = {r.bucket: r.n for r in totals(bucketed(target.select("text"), buckets)).collect()}
    scored = weigh(rows, gains(have, want, buckets)).select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), ((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()).alias("__open"), F.monotonically_increasing_id().alias("__row")
    )
    scored = cut(scored, "scored")
    forget(rows)
    counts = sorted(((r.score, r.n) for r in scored.where("__open").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = percent * sum(n for _, n in counts) // 100
    least, met = None, 0
    for score, n in counts:
        if met >= draw:
            break
        least, met = score, met + n
    top = F.col("__open") & (F.col("score") >= F.lit(least)) if least is not None else F.lit(False)
    slim = scored.withColumn("__top", top)
    drawn = ranked(slim.where("__top").drop("__open", "__top"), 0).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = slim.where("not __top").drop("__open", "__top", "__row").withColumn("rank", F.lit(None).cast("long"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank").union(rest.select("doc_id", "n_features", "weight", "score", "rank"))
