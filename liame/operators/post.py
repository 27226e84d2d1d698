"""Figures derived from results: balances, masks, folds, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liame.functions.scoring import rank


def clamp(x: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def score(sort: str) -> Column:
    """What a map is sorted by."""
    return {"reach": F.col("reach").cast("double"), "pmi": rank(F.col("pmi"), F.col("count"))}.get(sort, F.col("count").cast("double"))


def balance(a: Column, b: Column) -> Column:
    """Where a term stands between two sides, -1 to 1; a term of one side alone stands at its end."""
    up = lambda x: F.greatest(x, F.lit(0.0))
    whole = F.abs(a) + F.abs(b)
    both = F.when(whole == 0, F.lit(0.0)).otherwise(clamp((up(b) - up(a)) / whole))
    return F.when(a.isNull() & b.isNull(), None).when(b.isNull(), F.lit(-1.0)).when(a.isNull(), F.lit(1.0)).otherwise(both)


def share_balance(recent: Column, words_recent: Column, base: Column, words_base: Column) -> Column:
    """Change of a term's share of all words in thirds of an octave, -1 to 1; null without words on a side."""
    ratio = (recent / words_recent) / ((base + 1) / words_base)
    return F.when((words_recent <= 0) | (words_base <= 0), None).when(recent <= 0, F.lit(-1.0)).otherwise(clamp(F.log2(ratio) / 3))


def lift_of_person(recent: Column, days: int, base: Column, baseline: int) -> Column:
    """Rise of the documents about a person, smoothed by one."""
    return (recent / F.lit(float(days))) / ((base + 1) / F.lit(float(baseline)))


def lift_balance(lift: Column, own: Column) -> Column:
    """A term's lift against the person's own, in thirds of an octave."""
    return F.when((lift <= 0) | (own <= 0), F.lit(-1.0)).otherwise(clamp(F.log2(lift / own) / 3))


def rare_risers(lifted: DataFrame, present: DataFrame) -> DataFrame:
    """Rising terms that aren't among the loud ones."""
    return lifted.where(F.col("lift") > 1).join(present.select("term", "kind"), ["term", "kind"], "left_anti")


def fold_testimony(by_domain: DataFrame) -> DataFrame:
    """Mean score per domain over its sources, weighted by their numbers."""
    return by_domain.groupBy("domain").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score"), F.sum("n").alias("n"))


def merge_outlets(sources: DataFrame, folded: DataFrame) -> DataFrame:
    """Outlets with the testimony of their domain."""
    return sources.join(folded.select("domain", F.col("score").alias("testimony"), F.col("n").alias("testimony_n")), "domain", "left")


def testimony_class(x: Column) -> Column:
    return F.when(x <= -2.5, "against").when(x >= 2.5, "for").when(x.isNotNull(), "neutral")


def term_mask(terms: DataFrame, overall: Column, least: int = 3) -> DataFrame:
    """Distance of each term's mean score from the person's own."""
    return terms.where(F.col("n") >= least).withColumn("mask", F.col("score") - overall)


def community_ranking(members: DataFrame, top: int = 6) -> DataFrame:
    """The largest communities, ties by number; (community, n, place)."""
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    return sizes.orderBy(F.desc("n"), "community").limit(top)


def agenda_rows(cells: DataFrame, persons: list[str]) -> DataFrame:
    """One row per outlet, one column per person."""
    return cells.groupBy("domain").pivot("person_id", persons).agg(F.first("share"))


def peak_day(series: DataFrame) -> DataFrame:
    """The first day with the most views."""
    return series.orderBy(F.desc("views"), "day").limit(1)


def lag_days(a: DataFrame, b: DataFrame) -> DataFrame:
    """Days from the peak of one series to that of another."""
    return peak_day(a).select(F.col("day").alias("day_a")).crossJoin(peak_day(b).select(F.col("day").alias("day_b"))).withColumn("lag", F.datediff("day_b", "day_a").cast("long"))


def comention_matrix(pairs: DataFrame) -> DataFrame:
    """The answer's pairs with their ink, from both ends; what is missing in it has none."""
    top = pairs.agg(F.max("count").alias("top"))
    ink = F.greatest(F.lit(0.18), F.col("count") / F.col("top"))
    rows = pairs.crossJoin(F.broadcast(top)).select("a", "b", "count", ink.alias("ink"))
    return rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "count", "ink"))


def level(count: Column, top: Column) -> Column:
    """Five steps of persistence."""
    return F.when(count.isNotNull() & (top > 0), F.greatest(F.lit(1), F.ceil(count / top * 5)).cast("long"))


def related(edges: DataFrame, node: str) -> DataFrame:
    """Neighbours of a node, the strongest first."""
    rows = edges.where((F.col("s") == node) | (F.col("t") == node)).select(F.when(F.col("s") == node, F.col("t")).otherwise(F.col("s")).alias("node"), "count")
    return rows.orderBy(F.desc("count"), "node")


def confusion(rows: DataFrame, threshold: float) -> DataFrame:
    """Precision and recall of a score against labels (label boolean) at a threshold."""
    hit = F.col("score") >= threshold
    n = rows.agg(F.count_if(hit & F.col("label")).alias("tp"), F.count_if(hit & ~F.col("label")).alias("fp"), F.count_if(~hit & F.col("label")).alias("fn"))
    return n.select("tp", "fp", "fn", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))


def percentiles(rows: DataFrame, column: str) -> DataFrame:
    """Median (mean of the middle two) and nearest-rank 95th percentile."""
    return rows.agg(F.expr(f"percentile_cont(0.5) within group (order by {column})").alias("p50"), F.expr(f"percentile_disc(0.95) within group (order by {column})").alias("p95"))
