"""Reading columnar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read parquet; how it is split is left to Spark's split size settings."""
    return spark.read.parquet(path)
