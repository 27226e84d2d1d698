"""Readers for the engine's tables, one parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read table ``name`` below ``folder``; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
