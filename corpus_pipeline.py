"""Corpus pipeline: documents to packed training sequences, one operator of ``dayspan.llm`` per stage.

Every stage works on all rows that the one before it kept. The first four return the columns of documents:

* language ID drops documents whose language can't be told (no letters, or a margin under the operator's bound);
* line dedup cuts repeated chunks of lines from the texts; a text that holds nothing else goes;
* the n-gram Jaccard join keeps, of each group of linked documents, the one with the smallest id;
* benchmark decontamination drops documents in which a window of a benchmark item occurs;
* best-fit packing gives each remaining document's place in the training sequences.

A document is its id and text: decisions hold for that pair, known by a 64-bit hash of both, and never for all rows of an
id. Rows equal in both are one document, of which the join keeps one row. A null id counts like any other value and sorts
last. Extra columns pass through the first four stages, whatever their names.

Workers keep what the largest batch took, and all stages share them. So batches of texts are bounded by bytes, not by rows
alone: ``BATCH_BYTES``, unless the session has a bound of its own.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.llm.common import stage, tasks_for
from dayspan.llm.decontamination import contamination
from dayspan.llm.language_id import language_scores
from dayspan.llm.line_chunks import remove_repeated_chunks
from dayspan.llm.packing import pack_documents
from dayspan.llm.partenum import jaccard_components
from dayspan.llm.queries import table, tokenizer_path

#: Bytes of an Arrow batch between Spark and Python, on the way there.
BATCH_BYTES = 1 << 20


def in_small_batches(function):
    """The stage on a session that bounds the bytes of a batch. It's read when the rows are made, so the setting stays."""

    @functools.wraps(function)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        setting = "spark.sql.execution.arrow.maxBytesPerBatch"
        if spark.conf.get(setting, None) is None:
            spark.conf.set(setting, BATCH_BYTES)
        return function(spark, docs, sf_dir)

    return bounded


def apart(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    key = apart("key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels that the documents carry; a label is never read when its document is judged."""
    prefix = apart("language")
    scored = language_scores(docs, docs.select("text", "lang"), prefix=prefix)
    return scored.where(~F.col(f"{prefix}rejected")).drop(*[f"{prefix}{c}" for c in ("lang_pred", "score", "rejected")])


@in_small_batches
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    count = apart("removed")
    cut = remove_repeated_chunks(docs, count=count)
    return cut.where((F.col(count) == 0) | F.col("text").rlike(r"[^ \t-\r]")).drop(count)


@in_small_batches
def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents of a component the one with the smallest id stays, once."""
    docs, key = keyed(docs)
    found = jaccard_components(docs.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id")
    ids = docs.groupBy(F.col(key).alias("key")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))).alias("id"), F.count(F.lit(1)).alias("rows"))
    members = found.distinct().join(ids, "key")
    kept = members.groupBy("component_id").agg(F.min(F.struct("id", "key", "rows")).alias("kept")).select("kept.*")
    # Both are small next to the texts, and written first so that their size is known before texts would be shuffled.
    tasks = tasks_for(spark, 0)
    gone = stage(members.join(kept.select("key"), "key", "left_anti").select(F.col("key").alias(key)), "gone", tasks)
    repeated = stage(kept.where("rows > 1").select(F.col("key").alias(key)), "repeated", tasks)
    once = docs.join(gone, key, "left_anti").join(repeated, key, "left_anti")
    return once.unionByName(docs.join(repeated, key, "left_semi").dropDuplicates([key])).drop(key)


@in_small_batches
def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, key = keyed(docs)
    found = contamination(docs.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    dirty = found.where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(dirty, key, "left_anti").drop(key)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path(), end_id=2, capacity=1024)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_copies),
    ("benchmark_decontamination", drop_benchmark_text),
    ("best_fit_packing", pack),
]

#: Compression, rolling boundaries, components and tokens can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
