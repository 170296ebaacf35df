"""Sharding by Hilbert-curve order.

Several metadata dimensions are quantised to BITS bits each, rows are ordered by
their place on the Hilbert curve through these cells, and the order is cut into
runs of equal length.  Neighbours on the curve are near in every dimension, so a
shard covers a compact box and filters on any dimension skip most shards.

Numbers are quantised at their approximate quantiles, from a sketch of fixed
size over all rows, strings at the exact ones in their whole order.  Ranks come from counts per cell: a
cell is split by a hash into parts of about PART rows, so no cell, however
common, meets in one task, and only slim rows are shuffled.

The law is `rows`: shard sizes differ by one at most.

Cases.  Null texts have size 1 and the crc32 of ''.  Null dimensions are lowest.
Rows of a cell go by a hash of their values and a written number.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import cut, forget

BITS, PART = 4, 50_000
#: Repeated rows are dealt over so many numbers, as they cannot be told apart otherwise.
SALTS = 64
#: The curve's table has 2 ** (BITS * dimensions) rows and is broadcast.
MOST_DIMENSIONS = 4


def hilbert(point: tuple[int, ...], bits: int = BITS) -> int:
    """Index of a cell on the Hilbert curve, by Skilling's transform."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in reversed(range(bits)):
        for v in x:
            out = out << 1 | ((v ^ t) >> b & 1)
    return out


def curve(spark: SparkSession, dimensions: int, bits: int = BITS) -> DataFrame:
    """code (the quantised values, side by side) and cell of all cells: 2 ** (bits * dimensions) rows, whatever the data."""
    width = (1 << bits) - 1
    rows = [(c, hilbert(tuple(c >> bits * i & width for i in range(dimensions)), bits)) for c in range(1 << bits * dimensions)]
    return spark.createDataFrame(rows, "code int, cell int")


def text_cuts(df: DataFrame, column: str, bits: int) -> list[str]:
    """Values at which the rows' shares of a string column pass i / 2 ** bits, in the full order of strings.

    Rows are summed per value, so a common one is a single row; values are dealt
    by range and summed within each range, and the ranges' totals come first."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranged = cut(values.repartitionByRange(F.col("v")).select("v", "n", F.spark_partition_id().alias("p")), "values")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("p").agg(F.sum("n").alias("t")).select("p", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    upto = F.sum("n").over(Window.partitionBy("p").orderBy("v"))
    rows = ranged.withColumn("upto", upto).join(F.broadcast(totals), "p").withColumn("upto", F.col("base") + F.col("upto"))
    total = ranged.agg(F.sum("n")).first()[0] or 0
    got = rows.agg(*[F.min(F.when(F.col("upto") * (1 << bits) >= i * total, F.col("v"))) for i in range(1, 1 << bits)]).first()
    return sorted((x for x in got if x is not None), key=lambda x: x.encode())


def quantise(df: DataFrame, columns: list[str], bits: int = BITS) -> list[Column]:
    """For each column the number of its cuts below a value: 0 to 2 ** bits - 1, nulls 0.

    A value that is several cuts counts as many, so a column of few values still has codes from the whole range: its values differ in the curve's high bits."""
    text = {c for c in columns if df.schema[c].dataType.simpleString() == "string"}
    numbers = [c for c in columns if c not in text]
    wanted = F.array(*[F.lit(i / (1 << bits)) for i in range(1, 1 << bits)])
    found = df.agg(F.lit(0), *[F.percentile_approx(F.col(c).cast("double"), wanted, 2000).alias(f"c_{c}") for c in numbers]).first()
    edges = {c: text_cuts(df, c, bits) if c in text else sorted(found[f"c_{c}"] or []) for c in columns}
    counted = {c: {e: edges[c].count(e) for e in edges[c]} for c in columns}
    return [reduce(lambda a, e: a + F.when(F.col(c) > e[0], e[1]).otherwise(0), counted[c].items(), F.lit(0)) for c in columns]


def slim(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    own = ["__row"] if "__row" in docs.columns else []
    return docs.select(*own, F.col("doc_id").cast("long"), "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))


def shard(docs: DataFrame, shards: int = 16, dimensions: tuple[str, ...] = ("source", "lang", "size")) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and cell (the curve index)."""
    if len(dimensions) > MOST_DIMENSIONS:
        raise ValueError(f"at most {MOST_DIMENSIONS} dimensions")
    rows = cut(slim(docs), "slim")
    cells = quantise(rows, list(dimensions))
    total = rows.count()
    parts = max(1, -(-total // PART))
    code = sum((c * (1 << BITS * i) for i, c in enumerate(cells[1:], 1)), cells[0])
    rows = rows.withColumn("code", code.cast("int")).join(F.broadcast(curve(docs.sparkSession, len(cells))), "code")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "salt"), F.lit(parts)))
    # cells are bounded in number, parts grow with the rows: one row for each PART of them at most, summed before it is shuffled
    counts = rows.groupBy("cell", "part").agg(F.count("*").alias("n"))
    per_cell = counts.groupBy("cell").agg(F.sum("n").alias("m"))
    offsets = per_cell.withColumn("before", F.sum("m").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))).select("cell", F.coalesce("before", F.lit(0)).alias("before"))
    inner = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(F.broadcast(offsets), "cell").select("cell", "part", (F.col("before") + F.col("inner")).alias("start"))
    place = F.row_number().over(Window.partitionBy("cell", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("place", place).join(starts, ["cell", "part"]).withColumn("rank", F.col("start") + F.col("place"))
    small, larger = divmod(total, shards)
    edge = larger * (small + 1)
    shard_of = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (small + 1))).otherwise(larger + F.floor((F.col("rank") - edge) / max(1, small)))
    first = F.when(F.col("shard") < larger, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - larger) * small)
    out = ranked.withColumn("shard", shard_of.cast("int")).withColumn("slot", (F.col("rank") - first).cast("long"))
    own = ["__row"] if "__row" in docs.columns else []
    return out.select(*own, "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("cell").cast("int").alias("cell"))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Writes docs with their shard as partition directories, each sorted by slot.

    Rows are numbered in a copy of their own, so that repeated ones each have their place in the plan."""
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    plan = shard(rows, shards).select("__row", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    both = rows.join(plan, "__row")
    both.select(*docs.columns, "__shard", "__slot").repartition("__shard", F.floor(F.col("__slot") / PART)).sortWithinPartitions("__shard", "__slot").drop("__slot").withColumnRenamed("__shard", "shard").write.partitionBy("shard").parquet(path)
    forget(rows)
