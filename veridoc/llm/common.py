"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def setting(spark: SparkSession, key: str) -> str | None:
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (local runs only) a folder in the warehouse."""
    found = setting(spark, "spark.checkpoint.dir")
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back.

    A lost executor then costs a reread and not a recomputation of all that lies before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST = 64 << 20  # bytes of a table that is sent to every task


def small_side(df: DataFrame, size: Column) -> DataFrame:
    """A stored table, marked for broadcast if the sum of ``size`` (bytes of a row) is at most BROADCAST; else it is joined shuffled."""
    held = df.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of an Arrow batch, so that Python workers hold a few MB of texts at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """Binds an array-valued expression to a lambda variable, so that ``body`` can use it
    any number of times while it is computed once a row."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def collect_garbage(spark: SparkSession) -> None:
    """The same for the JVMs of the executors: a full collection shrinks a heap to what is in use, and frees direct buffers that only garbage holds.
    A task for each core reaches every executor that is not busy."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def release() -> None:
    """Gives a worker's free memory back to the system, so that what one stage needed does not add to the next one's."""
    import ctypes
    import gc

    import pyarrow as pa

    from veridoc.llm import textbytes

    textbytes.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
