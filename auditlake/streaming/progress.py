"""Crawl progress as a stream: throughput in sliding windows of event time, each url once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def urls_per_second(events: DataFrame, seconds: int = 10, slide: int = 1, late: str = "30 seconds") -> DataFrame:
    """events (ts, ...): batch or stream."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("per_second"))


def new_urls(pages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """pages (ts, url, ...) without repeats within the watermark."""
    return pages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url"]) if pages.isStreaming else pages.dropDuplicates(["url"])
