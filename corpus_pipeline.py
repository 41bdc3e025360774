"""Corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, packing.

Each stage works on all that the one before kept, written as Parquet in between. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import decontamination, language, near_duplicates, packing, suffix_dedup
from stratalens.llm.common import discard, free_name, scratch, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised."""
    return language.recognised(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id."""
    return near_duplicates.representatives(docs)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; a document of nothing else goes."""
    had = free_name("had_", docs.columns)
    out = suffix_dedup.remove_repeats(docs.withColumn(had, F.length("text") > 0))
    return out.filter(~F.coalesce(F.col(had), F.lit(False)) | (F.length("text") > 0)).drop(had)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in fixed-length sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_array", suffix_array),
    ("benchmark_leaks", benchmark_leaks),
    ("sequences", sequences),
]

#: Models and iterations: SQL expresses no stage. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``. What a stage writes and reads goes as its result stands."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with scratch() as kept:
            out = written(stage(spark, docs, sf_dir), f"pipeline-{k}-{name}", large=True)
            kept.append(out)
        if k:
            discard(docs)
        docs = out
    return docs
