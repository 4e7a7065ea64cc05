"""Incremental work: what changed between listings, and folders watched as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import corpus


def stale_hashes(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path, mtime, size) that the cache (path, mtime, size, hash) doesn't vouch for. The cache saves work; it never verifies."""
    return listing.join(cache.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def refreshed(listing: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache of the listed files: kept rows, and fresh ones (path, mtime, size, hash)."""
    kept = cache.join(listing.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi")
    return kept.select("path", "mtime", "size", "hash").unionByName(fresh.select("path", "mtime", "size", "hash"))


def document_stream(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """New files of a folder as a stream of parsed documents, relative to the folder."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/") + "/"
    path = F.regexp_replace("path", "^file:/*", "/")
    return corpus.documents(raw.select(F.replace(path, F.lit(base), F.lit("")).alias("path"), "content"))


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows of a stream or a table; rows later than the watermark are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a stream over what there is, batch by batch; each batch is delivered with its number, so that a sink can be idempotent."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
