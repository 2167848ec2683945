"""The corpus pipeline: classify, drop near copies, decontaminate, redact, mix. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundline.llm import decontamination, jaccard, mixing, pii, resampling
from groundline.llm.common import written
from groundline.sources.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go."""
    return resampling.select(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share eight tenths of their five-word shingles, through any chain of links, the first id stays."""
    return jaccard.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers and names, go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in capitals; ``n_chars`` follows the new text."""
    return pii.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the words it takes of each; those it takes nothing of go."""
    return mixing.take_documents(docs)


STAGES = [("quality_classifier", quality_classifier), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("personal_data", personal_data), ("mix", mix)]

#: Trees, tries, hashes and components are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again.

    Null and empty texts: the classifier puts them after all others, so they go once any label names a good document; without labels they reach
    the mix, which takes nothing of them. A null id or source is a value like others. Rows equal in id and text are copies, of which the second
    stage keeps one. Empty tables give an empty result with the same columns. Other columns of ``documents`` stay, whatever their names. The
    result is lazy: ``groundline.sources.scratch.clear`` deletes the stages' tables once it has been written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
