"""Fetched pages as a stream, merged into a stored project batch by batch.

Exact repeats of a fetch are dropped by a watermark on its time; each batch is
parsed and built like a crawl of its own and merged under the stream's name and the
batch's number, so a batch that runs again after a failure changes nothing.  Views
read a whole version at any time, while the stream runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import site
from ..store import forget, numbered
from ..stored import Stored


def add(store: Stored, batch: DataFrame, name: str, number: int) -> int:
    """One batch of fetched pages (ts, url, html, and columns of pages) merged; gives the store's version.  Of an url's fetches the latest stays."""
    if store.config.known_by != "url":
        raise ValueError("fetches of a stream are known by url")
    if store.state()["batches"].get(name, -1) >= number:
        return store.state()["version"]
    columns = [c for c in batch.columns if c != "id"]
    latest = batch.where("url is not null").groupBy("url").agg(F.max_by(F.struct(*columns), "ts").alias("x")).select("x.*")
    raw = numbered(latest, [F.col("url").asc()], "batch").withColumnRenamed("place", "id").drop("ts")
    built = site.build(batch.sparkSession, raw, config=store.config)
    version = store.merge({k: v for k, v in built.tables.items() if k not in ("sitemap_urls", "meta")}, batch=(name, number))
    forget(raw)
    return version


def ingest(pages: DataFrame, store: Stored, checkpoint: str, name: str = "pages", late: str = "10 minutes", **trigger: object) -> StreamingQuery:
    """pages: a stream of ts, url, html and what else a crawl knows of a page; trigger: as of writeStream.trigger."""
    once = pages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url", "ts"])
    writer = once.writeStream.foreachBatch(lambda batch, number: add(store, batch, name, number)).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(**trigger) if trigger else writer).start()
