"""WARC archives, read back by boundary-chain verification.

Writing: one record per page; of equal payloads the one with the smallest id is
a response, the others are revisits of it.  Rows are written by Spark's text
writer, whose line separator is the end of a record, so any store that Spark
writes will do and failed tasks leave nothing behind.

Reading: files are split at the magic line, wherever it stands.  A task sums up
the bytes that it has passed, so each piece has its offset in the file, which
every later read finds again.  Each piece states a candidate record and the
offset of its successor, from its header's length.  Pieces that end where the
next begins are contracted to runs within ranges of RANGE bytes; pointer jumping
from each file's start then keeps the runs that can be reached, so magic inside
a payload starts no record.  Payloads that hold such lines are put together
again from the pieces in their range of offsets.

Cases.  Null payloads are empty; empty payloads count as equal if min_bytes is
0.  A null id makes a response of its own, with no id when read back.  Repeated
rows with one id have one type.  Control characters and spaces in URLs are
percent-encoded, null URLs are urn:x-page:<id>.  Other columns are ignored.
No pages give no records.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import cut, new_path, shuffles_freed
from .hot import hot_keys, join_around

MAGIC = "WARC/1.0\r\n"
EOL, GAP = "\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of a file whose pieces one task orders, and of a bin in which broken records look for their pieces.
RANGE, BIN = 64 << 20, 1 << 20


def base32(sha: str) -> Column:
    """A column of 40 hex digits in base 32: each 5 of them are 20 bits, hence 4 letters."""
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(sha, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def marked(pages: DataFrame, min_bytes: int) -> DataFrame:
    """pages (page_id, url, html) with payload, size, digest and first: the id that a revisit refers to."""
    payload = F.coalesce("html", F.lit(""))
    out = pages.select("page_id", "url", payload.alias("payload")).withColumns({"size": F.octet_length("payload"), "sha": F.sha1("payload")})
    out = out.withColumn("digest", base32("sha")).drop("sha")
    slim = cut(out.select("page_id", "digest", "size"), "digests")
    first = slim.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # a payload that very many pages have is dealt over many tasks
    later = join_around(slim, first, ["digest", "size"], hot_keys(slim, "digest", F.col("page_id"))).where("page_id > first").select("page_id", "digest", "first").distinct()
    return out.join(later, ["page_id", "digest"], "left")


def lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; fields without a value are left out."""
    return F.concat_ws(EOL, *[F.concat(F.lit(f"{k}: "), v) for k, v in fields])


def write(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip") -> None:
    rows = marked(pages, min_bytes)
    ident = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    url = reduce(lambda u, c: F.replace(u, F.lit(chr(c)), F.lit(f"%{c:02X}")), [*range(33), 127], F.coalesce("url", F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(GAP))
    block_size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    head = lines(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", ident("page_id")), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("WARC-Profile", F.when(revisit, PROFILE)), ("WARC-Refers-To", F.when(revisit, ident("first"))), ("X-Payload-Length", F.col("size").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", block_size.cast("string")),
    )
    record = F.concat(F.lit(MAGIC), head, F.lit(GAP), http, F.when(revisit, "").otherwise(F.col("payload")))
    with shuffles_freed(pages.sparkSession):
        rows.select(record.alias("value")).write.option("lineSep", GAP).option("compression", compression).text(path)


def field(head: Column, name: str) -> Column:
    """The value of a header field, '' without it."""
    return F.regexp_extract(F.concat(F.lit(EOL), head), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic lines: file, split (its first byte), bytes and value, in order within each split."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.octet_length("value").alias("bytes"), "value")


def with_offsets(rows: DataFrame) -> DataFrame:
    """rows as they are read, with within: bytes of the split before them.  Batches stream through, so nothing is held but a sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size, ends = batch.column(2).to_numpy().astype(np.int64) + len(MAGIC), [(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()) for i in (0, -1)]
            if ends[0] == ends[1]:  # splits come one after the other, so all rows are of one
                before = before if ends[0] == last else 0
                sums = np.cumsum(size)
                within, last, before = before + sums - size, ends[0], before + int(sums[-1])
            else:
                within = np.zeros(len(size), np.int64)
                for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    last, before = key, before if key == last else 0
                    within[i] = before
                    before += int(size[i])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within, pa.int64())], [*batch.schema.names, "within"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("within", T.LongType())]))


def parsed(rows: DataFrame) -> DataFrame:
    """rows with the parts of value, a whole record without its magic line: header, length, payload's SHA-1 in hex and size.

    Each part has a projection of its own, since a later one that names it more than once would else compute it as often."""
    rows = rows.withColumn("head", F.substring_index("value", GAP, 1))
    ok = (F.octet_length("head") < F.octet_length("value")) & (field(F.col("head"), "WARC-Type") != "")
    rows = rows.withColumns({"block": F.substring("value", F.length("head") + 5, F.length("value") - F.length("head") - 8), "ok": ok})
    whole = F.octet_length("head") + F.lit(8) + field(F.col("head"), "Content-Length").try_cast("bigint")
    rows = rows.withColumn("payload", F.substring("block", F.length(F.substring_index("block", GAP, 1)) + 5, F.length("block")))
    return rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload"), "whole": F.when(F.col("ok"), whole), "head": F.when(F.col("ok"), F.col("head"))}).drop("block", "payload", "ok")


def bases(found: DataFrame) -> DataFrame:
    """file, split, base: bytes of the file before each split, from one sum a split."""
    total = found.groupBy("file", "split").agg((F.sum(F.col("bytes") + len(MAGIC))).alias("total"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return total.select("file", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def placed(found: DataFrame, base: DataFrame) -> DataFrame:
    """found with at: the offset of the magic before each piece."""
    return found.join(base, ["file", "split"]).withColumn("at", F.col("base") + F.col("within") - len(MAGIC)).drop("split", "base", "within")


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Slim rows of all pieces: file, at (offset of the magic), next (offset of the successor that the header claims), full (the piece is a whole record); and the splits' bases."""
    rows = parsed(pieces(spark, path))
    full = F.col("whole") == F.col("bytes")
    rows = rows.select("file", "split", "bytes", "head", "whole", F.coalesce(full, F.lit(False)).alias("full"), F.when(full, F.col("sha")).alias("sha"), F.when(full, F.col("size")).alias("size"))
    found = cut(with_offsets(rows), "pieces")
    base = cut(bases(found), "bases")
    return placed(found, base).withColumn("next", F.col("at") + len(MAGIC) + F.col("whole")), base


def reachable(found: DataFrame) -> DataFrame:
    """The candidates on the chain from each file's start."""
    jumps = cut(found.where("whole is not null and not full").select("file", F.col("next").alias("at")).distinct().withColumn("target", F.lit(True)), "targets")
    w = Window.partitionBy("file", "range").orderBy("at")
    rows = found.where("at >= 0").withColumn("range", F.floor(F.col("at") / RANGE)).join(jumps, ["file", "at"], "left")
    # a range's first piece begins a run, too: it may be that of a jump from the range before
    fresh = F.coalesce("target", F.lit(False)) | ~F.coalesce(F.lag("full").over(w), F.lit(False)) | ~F.col("full") & F.col("whole").isNull()
    rows = rows.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(w))
    rows = cut(rows.where("whole is not null"), "runs")
    nodes = cut(rows.groupBy("file", "range", "run").agg(F.min("at").alias("at"), F.max_by("next", "at").alias("next")), "nodes")
    heads = nodes.select("file", "at")
    reached = cut(nodes.where("at = 0").select("file", "at"), "reached")
    jump = nodes.select("file", "at", "next")
    while True:
        new = jump.join(reached, ["file", "at"]).select("file", F.col("next").alias("at")).join(heads, ["file", "at"], "left_semi").join(reached, ["file", "at"], "left_anti").distinct()
        grown = cut(reached.union(new), "reached")
        if grown.count() == reached.count():
            break
        hop = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        reached, jump = grown, cut(jump.join(hop, ["file", "next"]).select("file", "at", F.col("far").alias("next")), "jumps")
    kept = nodes.join(grown, ["file", "at"], "left_semi").select("file", "range", "run")
    return rows.join(kept, ["file", "range", "run"], "left_semi")


@contextlib.contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """While it holds, files are split alike in every read, whatever executors come and go."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records: page_id, record_type, payload_bytes, payload_digest, refers_to, target_uri, digest_ok."""
    with same_splits(spark):
        return records(spark, path)


def records(spark: SparkSession, path: str) -> DataFrame:
    found, base = candidates(spark, path)
    good = cut(reachable(found), "records")
    out = good.where("full").select("file", "at", "head", "sha", "size")
    broken = good.where("not full").select("file", "at", "next")
    if not broken.isEmpty():
        # pieces and broken records meet by ranges of offsets, not by whole files
        bin_of = lambda c: F.floor(F.col(c) / BIN)
        spans = broken.withColumn("bin", F.explode(F.sequence(bin_of("at"), F.floor((F.col("next") - 1) / BIN))))
        inside = found.select("file", F.col("at").alias("piece_at")).withColumn("bin", bin_of("piece_at"))
        spread = cut(inside.join(spans, ["file", "bin"]).where("piece_at >= at and piece_at < next").select("file", "piece_at", "at", "next"), "inside")
        values = placed(with_offsets(pieces(spark, path)), base).select("file", F.col("at").alias("piece_at"), "value")
        parts = values.join(spread, ["file", "piece_at"]).groupBy("file", "at", "next").agg(F.array_sort(F.collect_list(F.struct("piece_at", "value"))).alias("v"))
        parts = cut(parts, "parts")
        value = F.array_join(F.transform("v", lambda x: x["value"]), MAGIC)
        out = out.unionByName(parsed(parts.select("file", "at", value.alias("value"))).select(out.columns))
    out = out.withColumn("digest", base32("sha"))
    revisit = field(F.col("head"), "WARC-Type") == "revisit"
    claimed = F.regexp_extract(field(F.col("head"), "WARC-Payload-Digest"), "^sha1:(.*)$", 1)
    number = lambda name: F.regexp_extract(field(F.col("head"), name), "^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("bigint")
    return out.select(
        number("WARC-Record-ID").alias("page_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, field(F.col("head"), "X-Payload-Length").try_cast("bigint")).otherwise(F.col("size")).cast("long").alias("payload_bytes"),
        F.when(revisit, claimed).otherwise(F.col("digest")).alias("payload_digest"), number("WARC-Refers-To").alias("refers_to"),
        field(F.col("head"), "WARC-Target-URI").alias("target_uri"), (revisit | (claimed == F.col("digest"))).alias("digest_ok"),
    )


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages to the shared folder and reads the archives back."""
    path = new_path(spark, "warc")
    write(pages, path, min_bytes)
    return read(spark, path)
