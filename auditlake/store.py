"""Places that all executors share, and cutting of lineage through them.

``spark.checkpoint.dir`` names the shared folder.  Only where it is unset (a
local session, as in tests) a folder of this process is made and set.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session."""
    found = spark.conf.get(_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="auditlake-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """While it holds, Spark deletes a write's shuffle files when the write is done, not when the driver's garbage is collected."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


@contextlib.contextmanager
def few_per_batch(spark: SparkSession, rows: int = 8) -> Iterator[None]:
    """While it holds, batches for Python have few rows: for columns of whole files."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextlib.contextmanager
def joined_by_key(spark: SparkSession) -> Iterator[None]:
    """While it holds, joins deal both sides out by key and take none through the driver, however small Spark takes it to be; broadcasts that are asked for stay."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """df with its place in an order, from start: sorted by ranges and written; each range begins after the rows of those before.

    One row a range goes through the driver.  The order should tell all rows apart, or a hot value makes one large range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = cut(ranged, name)
    part, place = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    begins, at = [], start
    for p, n in sorted((r.part, r.n) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        begins.append((p, at))
        at += n
    begin = df.sparkSession.createDataFrame(begins, "__part long, __begin long")
    return ranged.withColumn("__part", part).join(F.broadcast(begin), "__part").withColumn("place", F.col("__begin") + place).drop("__part", "__begin", "__at")


def file_system(spark: SparkSession, path: str) -> tuple[object, object]:
    """The file system of a path and the path, as Hadoop has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder; none if there is no such folder."""
    fs, at = file_system(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all, and never a second time."""
    folder, _, name = path.rpartition("/")
    fs, at = file_system(spark, path)
    _, draft = file_system(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = fs.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise FileExistsError(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    The files outlive lost executors, and a wrong or repeated attempt of a task
    can't change what later stages read.  ``drop`` removes them.
    """
    return cut_all([df], name)


def cut_all(parts: list[DataFrame], name: str) -> DataFrame:
    """The rows of all parts, which have the same columns, written one part after the other as cut does."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = new_path(spark, name)
    with shuffles_freed(spark):
        for df in parts:
            df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes the files of what cut has returned, once nothing will read it again."""
    for file in df.inputFiles()[:1]:
        drop(df.sparkSession, file.rpartition("/")[0])


def drop(spark: SparkSession, path: str) -> None:
    """Removes what new_path or cut has made."""
    fs, at = file_system(spark, path)
    fs.delete(at, True)
