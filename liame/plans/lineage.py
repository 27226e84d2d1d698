"""Cutting lineage through files that outlive executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> None:
    """Make sure a checkpoint folder is set.

    The folder named in ``spark.checkpoint.dir`` is used as it is. Only where
    the session names none, and only on a local master, a temporary folder is
    set; a cluster without the setting is an error, for a machine's own folder
    would not be seen by its executors.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="liame-checkpoint-")
    sc.setCheckpointDir(folder)


def release(df: DataFrame) -> None:
    """Removes the files of a ``cut`` that nothing reads any more."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRDD":
        return
    place = plan.rdd().getCheckpointFile()
    if place.isDefined():
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(place.get())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder; its plan starts from those files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
