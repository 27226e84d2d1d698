"""Keeping stored tables in order: schemas, statistics, plans and digests of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def migrated(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``rows`` in a newer schema: columns it lacks are null, others are cast; columns the schema lacks stay behind."""
    there = {f.name for f in rows.schema.fields}
    return rows.select(*[(F.col(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def result_hash(rows: DataFrame) -> DataFrame:
    """(rows, digest): equal for results of equal rows in any order; one pass, combined in every task.

    Hashes are summed as decimals, so a row that stands twice counts twice.
    """
    each = F.xxhash64(*sorted(rows.columns)) if rows.columns else F.lit(0)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(each.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def explained(rows: DataFrame, mode: str = "formatted") -> str:
    """The plan as text, to be kept beside a baseline."""
    spark = rows.sparkSession
    return spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), mode)


def analyzed(spark, table: str, columns: list[str] | None = None) -> None:
    """Statistics of a catalogue table after a build; tables read by path need none, adaptive execution measures them."""
    wanted = f"for columns {', '.join(f'`{c}`' for c in columns)}" if columns else ""
    spark.sql(f"analyze table {table} compute statistics {wanted}")
