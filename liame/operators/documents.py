"""Single documents and the names that stand in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liame.clock import ANCHOR, before
from liame.corpus import Corpus
from liame.operators.scope import since


def page(docs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of documents, newest first, in a stable order."""
    rows = docs.select("doc_id", "source", "domain", "published_at", "text", "uri", "tone").orderBy(F.desc("published_at"), F.desc("doc_id"))
    return (rows.offset(offset) if offset else rows).limit(limit)


def counted(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("total"))


def candidates(c: Corpus, days: int = 7, least: int = 5, limit: int = 50, at: str = ANCHOR) -> DataFrame:
    """Untracked names of the last ``days``, against the ``days`` before."""
    docs = since(c.docs, 2 * days, at).select("doc_id", "source", (F.col("published_at") >= before(days, at)).alias("recent"))
    rows = c.candidates.join(docs, "doc_id").groupBy("name").agg(
        F.count_if("recent").alias("count"), F.countDistinct(F.when(F.col("recent"), F.col("source"))).alias("sources"), F.count_if(~F.col("recent")).alias("previous")
    )
    return rows.where(F.col("count") >= least).orderBy(F.desc("count"), "name").limit(limit)


def candidate_samples(c: Corpus, names: DataFrame, days: int = 7, each: int = 3, at: str = ANCHOR) -> DataFrame:
    """The newest documents of each name."""
    docs = since(c.docs, days, at).select("doc_id", "source", "text", "published_at")
    rows = c.candidates.join(names.select("name"), "name", "left_semi").join(docs, "doc_id")
    w = Window.partitionBy("name").orderBy(F.desc("published_at"), F.desc("doc_id"))
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= each).select("name", "rn", "doc_id", "source", "text")
