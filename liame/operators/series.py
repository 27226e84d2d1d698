"""How attention to a person and its words change: rolling and calendar buckets, rise, persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liame.clock import ANCHOR, ZONE, anchor, before, day_start, folded_day, local_day
from liame.corpus import Corpus, Person
from liame.functions.scoring import is_name, pmi, rank, round2
from liame.operators.scope import Scope, about, country_filter, in_scope, one_of, since, tracked

DAY = 86_400 * 1_000_000


def _age(ts: str, at: str) -> Column:
    """Microseconds from a time to the anchor."""
    return F.expr(f"timestampdiff(MICROSECOND, {ts}, cast('{at}' as timestamp_ntz))")


def timeline(docs: DataFrame, days: int = 21, bucket_days: int = 7, at: str = ANCHOR) -> DataFrame:
    """(i, bucket_start, count) of rolling buckets counted back from the anchor.

    Bucket 0 is the newest and open towards the future; a document exactly one
    bucket old belongs to it. The oldest bucket starts with the window.
    """
    last = -(-days // bucket_days) - 1
    i = F.least(F.lit(last), F.greatest(F.lit(0), F.ceil(_age("published_at", at) / F.lit(bucket_days * DAY)).cast("int") - 1))
    hits = docs.groupBy(i.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    start = anchor(at) - F.expr(f"make_dt_interval(least((i + 1) * {bucket_days}, {days}))")
    spine = docs.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("i"))
    return spine.join(hits, "i", "left").select("i", start.alias("bucket_start"), F.coalesce("n", F.lit(0)).alias("count"))


def _days(spark: SparkSession, days: int, at: str) -> DataFrame:
    today = local_day(anchor(at))
    return spark.range(days).select(F.date_sub(today, F.col("id").cast("int")).alias("day"))


def _week_docs(c: Corpus, person: Person, scope: Scope, leans: dict[str, str] | None = None) -> DataFrame:
    """The person's documents with their local day, future ones today, from the first calendar day on."""
    first = F.date_sub(local_day(anchor(scope.at)), scope.days - 1)
    wide = in_scope(c.docs, Scope(scope.days + 1, scope.sources, scope.domains, scope.leans, scope.country, scope.at), leans)
    docs = wide.where(F.col("published_at") >= day_start(first)).withColumn("day", folded_day(F.col("published_at"), scope.at))
    return about(c, docs, person.id)


def week_about(c: Corpus, person: Person, scope: Scope, leans: dict[str, str] | None = None) -> DataFrame:
    """(day, start, about) of every calendar day of the window, empty ones too."""
    per = _week_docs(c, person, scope, leans).groupBy("day").agg(F.count(F.lit(1)).alias("about"))
    return _days(c.docs.sparkSession, scope.days, scope.at).join(per, "day", "left").select("day", day_start(F.col("day")).alias("start"), F.coalesce("about", F.lit(0)).alias("about"))


def week_terms(c: Corpus, person: Person, scope: Scope, limit: int = 8, kinds: tuple[str, ...] | None = None, leans: dict[str, str] | None = None) -> DataFrame:
    """The most frequent terms of each calendar day."""
    counts = c.doc_terms.join(_week_docs(c, person, scope, leans).select("doc_id", "day"), "doc_id").groupBy("day", "term_id").agg(F.count(F.lit(1)).alias("count"))
    rows = counts.join(c.terms, "term_id").where(~is_name(F.col("term"), person.tokens))
    kind = one_of(F.col("kind"), kinds)
    rows = rows if kind is None else rows.where(kind)
    w = Window.partitionBy("day").orderBy(F.desc("count"), "term", "kind")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).select("day", "rn", "term", "kind", "count")


def week_testimony(c: Corpus, scores: DataFrame, person: Person, scope: Scope, leans: dict[str, str] | None = None) -> DataFrame:
    """Mean score per calendar day that has one."""
    scored = _week_docs(c, person, scope, leans).select("doc_id", "day").join(scores.where((F.col("person_id") == person.id) & F.col("score").isNotNull()).select("doc_id", "score"), "doc_id")
    return scored.groupBy("day").agg(round2(F.avg("score")).alias("score"), F.count("score").alias("n"))


def rising_counts(c: Corpus, person: Person, scope: Scope, baseline: int = 14, kinds: tuple[str, ...] | None = None, leans: dict[str, str] | None = None) -> DataFrame:
    """(term, kind, c_recent, c_baseline, reach): documents per term in the window and in the one before, from one pass."""
    wide = in_scope(c.docs, Scope(scope.days + baseline, scope.sources, scope.domains, scope.leans, scope.country, scope.at), leans)
    recent = F.col("published_at") >= before(scope.days, scope.at)
    docs = about(c, wide, person.id).select("doc_id", recent.alias("recent"), "reach_reposts")
    counts = c.doc_terms.join(docs, "doc_id").groupBy("term_id").agg(
        F.count_if("recent").alias("c_recent"), F.count_if(~F.col("recent")).alias("c_baseline"), F.sum(F.when(F.col("recent"), F.col("reach_reposts"))).alias("reach")
    )
    rows = counts.join(c.terms, "term_id").where(~is_name(F.col("term"), person.tokens))
    kind = one_of(F.col("kind"), kinds)
    return (rows if kind is None else rows.where(kind)).select("term", "kind", "c_recent", "c_baseline", "reach")


def rising(counts: DataFrame, days: int = 7, baseline: int = 14, least: int = 3) -> DataFrame:
    """Terms with their daily rates and the lift of the recent over the smoothed baseline rate."""
    recent, base = F.col("c_recent") / F.lit(float(days)), F.col("c_baseline") / F.lit(float(baseline))
    lift = recent / ((F.col("c_baseline") + 1) / F.lit(float(baseline)))
    return counts.where((F.col("c_recent") >= least) & (F.col("c_recent") > 0)).select(
        "term", "kind", round2(recent).alias("count_recent"), round2(base).alias("count_baseline"),
        F.col("c_recent").alias("count_recent_raw"), F.col("c_baseline").alias("count_baseline_raw"), round2(lift).alias("lift"), "reach",
    )


def lifted(rows: DataFrame, limit: int = 40) -> DataFrame:
    return rows.orderBy(F.desc("lift"), "term", "kind").limit(limit)


def present(rows: DataFrame, limit: int = 40) -> DataFrame:
    return rows.orderBy(F.desc("count_recent_raw"), F.desc("lift"), "term", "kind").limit(limit)


def rising_totals(c: Corpus, counts: DataFrame, person: Person, scope: Scope, baseline: int = 14, leans: dict[str, str] | None = None) -> DataFrame:
    """Documents and words of both windows, before any floor."""
    wide = in_scope(c.docs, Scope(scope.days + baseline, scope.sources, scope.domains, scope.leans, scope.country, scope.at), leans)
    recent = F.col("published_at") >= before(scope.days, scope.at)
    docs = about(c, wide, person.id).agg(F.count_if(recent).alias("about_recent"), F.count_if(~recent).alias("about_baseline"))
    words = counts.agg(F.coalesce(F.sum("c_recent"), F.lit(0)).alias("words_recent"), F.coalesce(F.sum("c_baseline"), F.lit(0)).alias("words_baseline"))
    return docs.crossJoin(words)


def attention(views: DataFrame, person_id: str, days: int = 21, at: str = ANCHOR) -> DataFrame:
    """(day, views) of the window."""
    first = F.date_sub(F.to_date(anchor(at)), days)
    return views.where((F.col("person_id") == person_id) & (F.col("day") >= first)).select("day", "views")


def term_weeks(c: Corpus, weeks: int = 2, universe_days: int = 21, least: int = 2, top: int = 50, at: str = ANCHOR, tokens: DataFrame | None = None) -> DataFrame:
    """(person_id, term, kind, week, count, c_t): the best terms of every person and local week, all persons at once.

    Weeks begin on Monday; the current one is open. The surprise is held
    against the universe of the last ``universe_days``. ``tokens`` (person_id,
    names) are the persons' own words.
    """
    br = country_filter("br")
    monday = F.to_date(F.date_trunc("week", local_day(anchor(at))))
    universe = tracked(c, in_scope(c.docs, Scope(universe_days, at=at)).select("doc_id"))
    kinds = c.terms.where(F.col("kind").isin("word", "hashtag", "phrase"))
    c_t = c.doc_terms.join(universe, "doc_id").groupBy("term_id").agg(F.count(F.lit(1)).alias("c_t"))
    n = universe.agg(F.count(F.lit(1)).alias("n"))
    week = F.least(monday, F.to_date(F.date_trunc("week", local_day(F.col("published_at")))))
    docs = since(c.docs, 7 * weeks + 1, at).where(br).withColumn("week", week).where(F.col("week") >= F.date_sub(monday, 7 * (weeks - 1))).select("doc_id", "week").join(c.doc_persons, "doc_id")
    n_p = docs.groupBy("person_id", "week").agg(F.count(F.lit(1)).alias("n_p"))
    counts = c.doc_terms.join(docs, "doc_id").groupBy("person_id", "week", "term_id").agg(F.count(F.lit(1)).alias("c_pt")).where(F.col("c_pt") >= least)
    rows = counts.join(c_t, "term_id").join(kinds, "term_id").join(n_p, ["person_id", "week"]).crossJoin(F.broadcast(n))
    if tokens is not None:
        own = F.arrays_overlap(F.split("term", " "), F.col("names"))
        rows = rows.join(tokens, "person_id", "left").where(~F.coalesce(own, F.lit(False)))
    key = rank(pmi(F.col("c_pt"), F.col("n"), F.col("n_p"), F.col("c_t")), F.col("c_pt"))
    w = Window.partitionBy("person_id", "week").orderBy(key.desc(), "term", "kind")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).select("person_id", "term", "kind", "week", F.col("c_pt").alias("count"), "c_t")


def persistence(weeks_of_terms: DataFrame, weeks: int = 12, limit: int | None = 40, at: str = ANCHOR) -> DataFrame:
    """Per term the weekly counts (null where absent), streak and half-life; all array functions, no Python.

    The streak runs back from the newest week, or from the one before if that
    is empty. The half-life counts weeks from the latest peak among complete
    weeks to the first with half of it or less; an absent week is a fall.
    """
    monday = F.to_date(F.date_trunc("week", local_day(anchor(at))))
    slots = F.sequence(F.date_sub(monday, 7 * (weeks - 1)), monday, F.expr("interval 7 days"))
    rows = weeks_of_terms.where(F.col("week") >= F.date_sub(monday, 7 * (weeks - 1))).groupBy("person_id", "term", "kind").agg(
        F.map_from_entries(F.collect_list(F.struct("week", F.col("count").cast("long")))).alias("by_week"),
        F.count(F.lit(1)).alias("weeks_present"), F.sum("count").alias("total"),
    )
    rows = rows.withColumn("series", F.transform(slots, lambda w: F.element_at("by_week", w)))
    back = F.reverse("series")
    back = F.when(F.element_at("series", -1).isNull(), F.slice(back, 2, max(weeks - 1, 1))).otherwise(back)
    gap = F.array_position(F.transform(back, lambda x: x.isNull()), F.lit(True))
    streak = F.when(gap == 0, F.size(back)).otherwise(gap - 1).cast("long")
    done = F.slice("series", 1, max(weeks - 1, 1))
    top = F.array_max(done)
    peak = F.array_max(F.transform(done, lambda x, i: F.when(x == top, i)))
    falls = F.transform(done, lambda x, i: (i > peak) & (F.coalesce(x, F.lit(0)) <= top / 2))
    fall = F.array_position(falls, F.lit(True)) - 1
    half = F.when(F.lit(weeks > 2) & peak.isNotNull() & (fall >= 0), fall - peak).cast("long")
    rows = rows.select("person_id", "term", "kind", "series", streak.alias("streak"), half.alias("half_life"), "weeks_present", "total")
    if limit is None:
        return rows
    return rows.orderBy(F.desc("streak"), F.desc("weeks_present"), F.desc("total"), "term", "kind").limit(limit)
