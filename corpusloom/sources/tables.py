"""Readers for the project's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the test data layout: a parquet file or folder FOLDER/NAME.parquet."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
