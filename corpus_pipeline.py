"""Corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; a stage's result is written as
Parquet and read again as the next one's docs.  All but the last return the columns of ``documents``.

Defined cases, for every stage: null and empty texts are neither toxic nor near copies nor leaks, and stay, but for
exact dedup, which takes null for empty and keeps one of them; a null doc_id is kept like any other and comes last where
the smallest one stays; rows that repeat a doc_id and its text are one to exact dedup and share their fate elsewhere;
ties go to the smallest doc_id; texts of any length are taken whole; an empty table gives an empty one; columns besides
those of ``documents``, whatever their names, come back as they were; labels or benchmark items that are not there
reject nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotgraph.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from lotgraph.llm.scratch import small_batches, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    small_batches(spark)
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document with the smallest doc_id."""
    small_batches(spark)
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that hold the documents left."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
