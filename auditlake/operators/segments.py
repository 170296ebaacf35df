"""Segments: the first pattern of an ordered list that a URL matches."""

from __future__ import annotations

from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def usable(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine that will run the pattern can compile it."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile("(?i)" + pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return bool(pattern.strip())


def assign(pages: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """pages with segment; rules are (name, pattern), those with a bad pattern or no name are passed over.  Null for external pages and those never fetched."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed([r for r in rules if r[0].strip() and usable(pages.sparkSession, r[1])]):
        out = F.when(F.col("url").rlike("(?i)" + pattern), F.lit(name)).otherwise(out)
    return pages.withColumn("segment", F.when(F.expr("is_internal = 1 and fetched >= 1"), out))
