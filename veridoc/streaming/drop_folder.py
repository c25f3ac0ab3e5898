"""Structured Streaming over a drop folder (an extension): each micro-batch runs the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, root: str, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Starts a query that hands new files (doc_id, path, length, content) to ``each``; the checkpoint makes it resumable."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").load(root)
    docs = files.select(F.sha2("content", 256).alias("doc_id"), "path", "length", "content")
    writer = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
