"""How the relations lie on disk, so that windows prune files and joins on documents meet sorted rows."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liame.corpus import Corpus, corpus
from liame.operators.scope import DAY
from liame.plans.lineage import checkpoint_dir


T = TypeVar("T")


def store(c: Corpus, path: str, files: int | None = None) -> None:
    """Writes a corpus: documents by day of publication, junctions in ranges of doc_id, dimensions as they are.

    A window then reads only its days; a join on doc_id skips row groups by
    their minimum and maximum. ``files`` of a junction: by its size, if not given.
    """
    c.docs.withColumn(DAY, F.to_date("published_at")).repartition(F.col(DAY)).sortWithinPartitions("doc_id").write.mode("overwrite").partitionBy(DAY).parquet(f"{path}/docs")
    for name in ("doc_persons", "doc_terms", "candidates"):
        rows: DataFrame = getattr(c, name)
        spread = rows.repartitionByRange(files, "doc_id") if files else rows.repartitionByRange("doc_id")
        spread.sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/{name}")
    for name in ("terms", "persons", "phrases"):
        getattr(c, name).write.mode("overwrite").parquet(f"{path}/{name}")


def stored(spark: SparkSession, path: str) -> Corpus:
    """A corpus as ``store`` wrote it; its rows are distinct already, so no query pays for that again."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Corpus(read("docs"), read("doc_persons"), read("doc_terms"), read("terms"), read("persons"), read("candidates"), read("phrases"))


def once(spark: SparkSession, folder: str, what: str, write: Callable[[str], None]) -> str:
    """The place of something derived from a folder's tables, written on first use.

    It lies in the session's shared checkpoint folder, under the application
    and a digest of the tables' lengths and times, so changed tables are
    derived anew; the mark that it is whole is written last.
    """
    checkpoint_dir(spark)
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    at = hadoop.Path(folder)
    files = sorted((x.getPath().getName(), x.getModificationTime(), x.getLen()) for x in at.getFileSystem(conf).listStatus(at))
    digest = sha256(repr((folder, files)).encode()).hexdigest()[:16]
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/derived-{spark.sparkContext.applicationId}/{digest}/{what}"
    mark = hadoop.Path(f"{root}/_WHOLE")
    fs = mark.getFileSystem(conf)
    if not fs.exists(mark):
        write(root)
        fs.create(mark, True).close()
    return root


def served(spark: SparkSession, folder: str) -> Corpus:
    """The corpus of a folder, stored once per application and read from there."""
    return opened(spark, once(spark, folder, "corpus", lambda path: store(corpus(spark, folder), path)), stored)


_open: dict[tuple, object] = {}


def opened(spark: SparkSession, path: str, read: Callable[[SparkSession, str], T]) -> T:
    """What ``read`` gives for a place that no longer changes; its schemas are looked up once."""
    key = (id(spark), path)
    if key not in _open:
        _open[key] = read(spark, path)
    return _open[key]


def sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, bytes) of stored tables and their total; a missing one has null bytes."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    rows, total = [], 0
    for name, path in paths.items():
        at = hadoop.Path(path)
        fs = at.getFileSystem(conf)
        n = fs.getContentSummary(at).getLength() if fs.exists(at) else None
        rows.append((name, n))
        total += n or 0
    return spark.createDataFrame([*rows, ("total", total)], "name string, bytes long")
