"""The top N items of every group, with groups of any size.

Hot-cold split. Exact group counts tell heavy groups from light ones. Light
groups go through an ordinary window, whose limit Spark applies to every input
partition before rows move. The rows of a heavy group get a salt of their
item, are range-partitioned by group and salt, keep the N best of each salt,
and only those meet in the last window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liame.sources.tables import load


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_{k}"])
    return on


def top_n(rows: DataFrame, keys: list[str], item: str, score: str, n: int = 10, heavy: int = 100_000) -> DataFrame:
    """The ``n`` items of largest ``score`` per group; on equal scores the smaller item by bytes.

    Rows whose item or score is null rank nowhere. An item that stands more
    than once in a group counts once, with its largest score. Null keys form
    groups as any other value. Groups of more than ``heavy`` rows are salted;
    there are at most rows / heavy of them. Returns keys, item, score, rank.

    The light window ranks different (score, item) pairs, which can be limited
    before the shuffle; groups in which an item then stands twice, with two
    scores, are ranked again by their items.
    """
    rows = rows.select(*keys, item, score).where(F.col(item).isNotNull() & F.col(score).isNotNull())
    order = [F.desc(score), F.asc(item)]
    named = [F.col(k).alias(f"_{k}") for k in keys]
    hot = rows.groupBy(*keys).count().where(F.col("count") > heavy).select(*named, F.ceil(F.col("count") / heavy).cast("int").alias("_salts"))
    light = rows.join(hot, _same(rows, hot, keys), "left_anti")
    pairs = light.withColumn("rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n).distinct()
    twice = pairs.withColumn("_seen", F.count(F.lit(1)).over(Window.partitionBy(*keys, item))).where("_seen > 1").select(*named).distinct()
    simple = pairs.join(twice, _same(pairs, twice, keys), "left_anti")
    again = rows.join(twice, _same(rows, twice, keys), "left_semi").groupBy(*keys, item).agg(F.max(score).alias(score))
    again = again.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
    salted = (
        rows.join(hot, _same(rows, hot, keys)).select(*keys, item, score, F.pmod(F.xxhash64(item), F.col("_salts")).cast("int").alias("_salt"))
        .repartitionByRange(*keys, "_salt").groupBy(*keys, "_salt", item).agg(F.max(score).alias(score))
    )
    best = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_r") <= n)
    best = best.drop("_r", "_salt").withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
    out = [*keys, item, score, "rank"]
    return simple.select(*out).unionByName(again.select(*out)).unionByName(best.select(*out))


KEYS = ["days", "source", "person_id", "kind"]


def p5_ranked(spark: SparkSession, folder: str) -> DataFrame:
    top = top_n(load(spark, folder, "graph_terms"), KEYS, "term", "c_pt", 10)
    return top.withColumn("days", F.col("days").cast("long")).withColumn("rank", F.col("rank").cast("long"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_ranked(spark, folder).select(*KEYS, "term")


def p5_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 terms of every window and source by c_pt with any person and kind; the largest groups take the salted way."""
    top = top_n(load(spark, folder, "graph_terms"), ["days", "source"], "term", "c_pt", 50, 2_000)
    return top.select(F.col("days").cast("long").alias("days"), "source", "term", F.col("c_pt").cast("long").alias("c_pt"), F.col("rank").cast("long").alias("rank"))


QUERIES = {"p5_found": p5_found, "p5_ranked": p5_ranked, "p5_windows": p5_windows}

_TOP = """
with one as (select days, source, person_id, kind, term, max(c_pt) as c_pt from graph_terms where term is not null and c_pt is not null group by 1, 2, 3, 4, 5),
r as (select *, row_number() over (partition by days, source, person_id, kind order by c_pt desc, term) as rank from one)
"""
SQL = {
    "p5_found": _TOP + "select days::bigint as days, source, person_id, kind, term from r where rank <= 10",
    "p5_windows": """with one as (select days, source, term, max(c_pt) as c_pt from graph_terms where term is not null and c_pt is not null group by 1, 2, 3),
r as (select *, row_number() over (partition by days, source order by c_pt desc, term) as rank from one)
select days::bigint as days, source, term, c_pt::bigint as c_pt, rank from r where rank <= 50""",
    "p5_ranked": _TOP + "select days::bigint as days, source, person_id, kind, term, c_pt, rank from r where rank <= 10",
}
