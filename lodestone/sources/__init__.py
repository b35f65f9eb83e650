"""Readers of the driver's tables and of document files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
