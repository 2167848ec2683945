"""The training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm import decontamination, jaccard, licenses, mixing, oracles, pii, ppm, quality, repeats, resampling, warc
from groundline.sources.tables import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"), with_text=False)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs if "path" in docs.columns else docs.withColumn("path", F.lit(None).cast("string")))


def op8_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_mix": op2_mix,
    "op3_repeats": op3_repeats,
    "op4_repetition": op4_repetition,
    "op5_jaccard": op5_jaccard,
    "op6_templates": op6_templates,
    "op7_licenses": op7_licenses,
    "op8_resampling": op8_resampling,
    "op9_warc": op9_warc,
    "op10_ppm": op10_ppm,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix": oracles.MIX,
    "op3_repeats": oracles.REPEATS,
    "op4_repetition": oracles.repetition(quality.COVERAGE_LIMITS, quality.LINE_LIMIT, quality.SYMBOL_LIMIT),
    "op5_jaccard": oracles.JACCARD,
    "op9_warc": oracles.WARC,
}
