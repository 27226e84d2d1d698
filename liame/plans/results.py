"""Stored results of frequent questions, valid for one build of the aggregates."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, is_dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession


def key(route: str, params: object) -> str:
    """The same for questions that parse alike, different for all others."""
    value = asdict(params) if is_dataclass(params) and not isinstance(params, type) else params
    return sha256(json.dumps({"route": route, "query": value}, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def cached(spark: SparkSession, root: str, build: str, route: str, params: object, make: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of a question for this build, made and stored if there is none.

    Results lie under the build's name, so a new build meets none of the old
    ones; a write that died leaves no success mark and is made again.
    """
    path = f"{root}/{build}/{route}/{key(route, params)}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    mark = hadoop.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def forget(spark: SparkSession, root: str, keep: str) -> None:
    """Removes the results of every build but one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        for status in fs.listStatus(at):
            if status.getPath().getName() != keep:
                fs.delete(status.getPath(), True)
