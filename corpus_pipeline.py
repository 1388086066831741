"""A corpus pipeline of four stages over the documents table. Part of the llm subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm import langid, packing, simhash, substring
from cairnlake.plans.checkpoints import use_checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; what has no letters, or no language with a quarter of them, goes."""
    return langid.identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once; texts that keep nothing go, others stay as they are
    where nothing was removed, and n_chars follows the text."""
    kept_text, n_words, n_removed = substring.result_names(docs)
    kept = substring.remove_repeats(docs)
    changed = F.col(n_removed) > 0
    rows = kept.where(~changed | (F.col(kept_text) != ""))
    text = F.when(changed, F.col(kept_text)).otherwise(F.col("text"))
    n_chars = F.when(changed, F.char_length(kept_text).cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", n_chars).withColumn("text", text).select(*[f"`{c}`" for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing_stage),
]

#: Language models and tokenizers cannot be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written as Parquet in the shared folder and read again. Columns
    besides those of documents, whatever their names, stay until packing."""
    folder = f"{use_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
