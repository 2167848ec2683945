"""Reading the tables a query works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory, by Spark's own reader (any file system that Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
