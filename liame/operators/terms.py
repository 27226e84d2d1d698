"""Terms that stick to a person: counts, surprise, maps, signatures, links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liame.corpus import Corpus, Person
from liame.functions.scoring import is_name, pmi, rank, round2, signature_floor
from liame.operators.scope import Scope, about, in_scope, one_of, tracked


def term_counts(c: Corpus, docs: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """(term_id, term, kind, c_pt, tone, reach) over ``docs``; groups on the id and reads the text afterwards."""
    counts = (
        c.doc_terms.join(docs.select("doc_id", "tone", "reach_reposts"), "doc_id").groupBy("term_id")
        .agg(F.count(F.lit(1)).alias("c_pt"), F.avg("tone").alias("tone"), F.sum("reach_reposts").alias("reach"))
    )
    named = counts.join(c.terms, "term_id")
    return named.where(~is_name(F.col("term"), exclude)) if exclude else named


def term_totals(c: Corpus, docs: DataFrame) -> DataFrame:
    """(term_id, c_t) over ``docs``."""
    return c.doc_terms.join(docs.select("doc_id"), "doc_id").groupBy("term_id").agg(F.count(F.lit(1)).alias("c_t"))


def totals(c: Corpus, docs: DataFrame, person: Person) -> DataFrame:
    """One row (docs, tracked, about)."""
    named = c.doc_persons.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.col("person_id") == person.id).alias("mine"))
    return docs.agg(F.count(F.lit(1)).alias("docs")).crossJoin(named.agg(F.count(F.lit(1)).alias("tracked"), F.count_if("mine").alias("about")))


def sided_counts(c: Corpus, docs: DataFrame, persons: list[Person]) -> tuple[DataFrame, DataFrame]:
    """Counts per term over the tracked documents, and among them over those about each person, in one pass.

    Returns (term_id, c_t, c_0, tone_0, reach_0, c_1, ...) and the one-row
    totals (tracked, n_0, n_1, ...).
    """
    flags = [F.coalesce(F.max(F.col("person_id") == p.id), F.lit(False)).alias(f"is_{i}") for i, p in enumerate(persons)]
    marked = docs.select("doc_id", "tone", "reach_reposts").join(c.doc_persons.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(*flags), "doc_id")
    sides, sums = [], []
    for i in range(len(persons)):
        mine = F.col(f"is_{i}")
        sides += [
            F.count_if(mine).alias(f"c_{i}"), F.avg(F.when(mine, F.col("tone"))).alias(f"tone_{i}"), F.sum(F.when(mine, F.col("reach_reposts"))).alias(f"reach_{i}"),
        ]
        sums.append(F.count_if(mine).alias(f"n_{i}"))
    counts = c.doc_terms.join(marked, "doc_id").groupBy("term_id").agg(F.count(F.lit(1)).alias("c_t"), *sides)
    return counts, marked.agg(F.count(F.lit(1)).alias("tracked"), *sums)


def scored_side(c: Corpus, counts: DataFrame, n: DataFrame, i: int, exclude: list[str] | None) -> DataFrame:
    """One person's terms out of ``sided_counts``: count, tone, reach, raw pmi and the number of documents about the person."""
    rows = counts.where(F.col(f"c_{i}") > 0).join(c.terms, "term_id")
    rows = rows.where(~is_name(F.col("term"), exclude)) if exclude else rows
    return rows.crossJoin(F.broadcast(n)).select(
        "term", "kind", F.col(f"c_{i}").alias("count"), F.col(f"tone_{i}").alias("tone"), F.col(f"reach_{i}").alias("reach"),
        pmi(F.col(f"c_{i}"), F.col("tracked"), F.col(f"n_{i}"), F.col("c_t")).alias("pmi"), F.col(f"n_{i}").alias("about"),
    )


def scored_terms(c: Corpus, docs: DataFrame, person: Person, exclude: list[str] | None) -> DataFrame:
    """Every term of the person's documents with count, tone, reach, raw pmi and the number of documents about the person."""
    return scored_side(c, *sided_counts(c, docs, [person]), 0, exclude)


def nodes(scored: DataFrame, sort: str = "count", kinds: tuple[str, ...] | None = None, least: int = 2, limit: int = 40) -> DataFrame:
    """The term map: the ``limit`` best terms in a total order."""
    kind = one_of(F.col("kind"), kinds)
    rows = scored.where(F.col("count") >= least)
    rows = rows if kind is None else rows.where(kind)
    key = rank(F.col("pmi"), F.col("count")) if sort == "pmi" else F.col("count")
    return rows.orderBy(key.desc(), "term", "kind").limit(limit).select("term", "kind", "count", round2(F.col("pmi")).alias("pmi"), round2(F.col("tone")).alias("tone"), "reach")


def signature(scored: DataFrame, limit: int = 5) -> DataFrame:
    """The most surprising terms that are no accident, ordered by the rounded figure."""
    rows = scored.where(F.col("count") >= signature_floor(F.col("about"))).select("term", "kind", "count", round2(F.col("pmi")).alias("pmi"))
    return rows.orderBy(F.desc("pmi"), "term", "kind").limit(limit)


def graph_nodes(c: Corpus, person: Person, scope: Scope, **options) -> DataFrame:
    """The live term map; an untracked person has none, live or stored."""
    scored = scored_terms(c, in_scope(c.docs, scope), person, person.tokens)
    return nodes(scored if person.tracked else scored.limit(0), **options)


def wanted_terms(c: Corpus, keys: DataFrame) -> DataFrame:
    """(term_id, name) of the (kind, term) rows of ``keys``; a request's few terms, so they are the broadcast side if small."""
    return c.terms.join(keys.select("kind", "term").distinct(), ["kind", "term"]).select("term_id", F.concat_ws(":", "kind", "term").alias("name"))


def links(c: Corpus, docs: DataFrame, keys: DataFrame, least: int = 2) -> DataFrame:
    """(s, t, count) of the pairs of wanted terms that share ``least`` documents, s before t."""
    hits = c.doc_terms.join(wanted_terms(c, keys), "term_id").join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "name")
    a, b = hits.select("doc_id", F.col("name").alias("s")), hits.select("doc_id", F.col("name").alias("t"))
    return a.join(b, "doc_id").where("s < t").groupBy("s", "t").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)


def star(person: Person, rows: DataFrame) -> DataFrame:
    """Links from the person to the nodes of its map."""
    return rows.select(F.lit(person.id).alias("s"), F.concat_ws(":", "kind", "term").alias("t"), "count")


def induced(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with both ends among ``names`` (name)."""
    return edges.join(names.select(F.col("name").alias("s")), "s", "left_semi").join(names.select(F.col("name").alias("t")), "t", "left_semi").select("s", "t", "count")


def merged_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of two sides, counts of the same pair summed."""
    return a.unionByName(b).groupBy("s", "t").agg(F.sum("count").alias("count"))
