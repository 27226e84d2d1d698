"""Enough tasks for work that is heavy per byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tasks(spark: SparkSession) -> int:
    """Twice the cluster's cores, or the session's shuffle partitions if those are more."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` in enough partitions to keep all cores busy in a Python function.

    A scan of small compressed files has fewer splits than the cluster has
    cores, and adaptive execution merges partitions by bytes, not by work. Rows
    that have splits for all cores already stay where they are. For scans and
    materialised rows: asking for their partitions runs nothing.
    """
    spark = rows.sparkSession
    if rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return rows
    return rows.repartition(tasks(spark))
