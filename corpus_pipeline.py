"""Training-corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, token ids.

Each stage reads all its predecessor kept, is written as Parquet and reread.  All stages but the
last return the columns of ``documents``.  SQL expresses neither the classifier nor the
vocabulary, so there is no ORACLE_SQL; tests hold the pipeline against a plain version.

Defined cases, in every stage: a null or empty text is a document like any other (it is scored, has no near-duplicates, no
leaks and no personal data, and encodes to no ids); a null id is kept; a table without rows gives none; columns of any
names besides doc_id and text stay as they are; texts of any length are read whole.  Rows are judged by
their own text, so rows of one id with different texts are different documents; rows equal in id and words are copies.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm import bpe, decontaminate, ngram_join, pii, quality
from veridoc.llm.common import collect_garbage, small_side, stored, table
from veridoc.llm.queries import word_bpe

ORACLE_SQL = None


def fresh(stage):
    """Before the stage, the executors give back what the one before left."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return run


@fresh
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@fresh
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that with the least id (then text hash), once.  Documents without an id or
    without words stay."""
    rows = stored(ngram_join.similar_sets(docs).where("class_id is not null").select("doc_id", "text_hash", "class_id"), "classes")
    first = rows.groupBy("class_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = rows.join(first, "class_id").groupBy("doc_id", "text_hash").agg(F.max(F.struct("doc_id", "text_hash") == F.col("first")).alias("stays"), F.count("*").alias("copies"))
    marked = stored(marked.where("not stays or copies > 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), "stays"), "copies")
    own = docs.select(F.struct("*").alias("r"), F.col("doc_id").cast("bigint").alias("own_id"), F.xxhash64("text").alias("own_th"))
    joined = own.join(small_side(marked, F.lit(32)), (F.col("own_id") == F.col("id")) & (F.col("own_th") == F.col("th")), "left")
    back = lambda rows: rows.select(*[F.col("r").getField(c).alias(c) for c in docs.columns])
    once = back(joined.where("id is null"))
    if marked.where("stays").isEmpty():  # no row stands twice
        return once
    repeated = joined.where("stays").groupBy("own_id", "own_th").agg(F.min_by("r", F.xxhash64("r")).alias("r"))
    return once.unionByName(back(repeated))


@fresh
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document of which nothing is left goes."""
    return decontaminate.cut_spans(docs, table(spark, sf_dir, "benchmark"))


@fresh
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; no document goes."""
    return pii.redact(docs)


@fresh
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's token ids and the text decoded from them."""
    return bpe.encode(docs, word_bpe())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("pii", personal_data),
    ("bpe encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
