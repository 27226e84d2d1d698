"""Outlets: who writes about whom, in what tone, with which words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liame.clock import ANCHOR
from liame.corpus import Corpus, Person
from liame.functions.scoring import is_name, pmi, rank, round2
from liame.operators.scope import Scope, about, in_scope, one_of, outlet_domain, since, tracked
from liame.operators.terms import term_totals, totals


def sources(c: Corpus, person: Person, scope: Scope, leans: dict[str, str] | None = None, limit: int = 80) -> DataFrame:
    """Documents about the person per outlet and source, with mean tone."""
    docs = about(c, in_scope(c.docs, scope, leans), person.id)
    rows = docs.groupBy(outlet_domain().alias("domain"), "source").agg(F.count(F.lit(1)).alias("docs"), round2(F.avg("tone")).alias("tone"), F.count("tone").alias("tone_n"))
    return rows.orderBy(F.desc("docs"), F.asc_nulls_last("domain"), "source").limit(limit)


def labelled(rows: DataFrame, leans: DataFrame) -> DataFrame:
    """Rows with the lean of their domain (leans: domain, lean), null where none is known."""
    return rows.join(leans.select("domain", "lean"), "domain", "left")


def tone_matrix(c: Corpus, days: int = 21, least: int = 3, at: str = ANCHOR) -> DataFrame:
    """Mean tone per person and domain, over documents with both."""
    docs = since(c.docs, days, at).where(F.col("domain").isNotNull() & F.col("tone").isNotNull()).select("doc_id", "domain", "tone")
    rows = docs.join(c.doc_persons, "doc_id").join(c.persons.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    return rows.groupBy("person_id", "domain").agg(round2(F.avg("tone")).alias("tone"), F.count("tone").alias("n")).where(F.col("n") >= least)


def agenda(c: Corpus, scope: Scope, least: int = 5, limit: int = 30) -> DataFrame:
    """Share of an outlet's documents that name each person, for the outlets that write most; shares may sum to more than 1."""
    docs = in_scope(c.docs, scope).select("doc_id", outlet_domain().alias("domain")).where("domain is not null")
    rows = docs.join(c.doc_persons, "doc_id")
    top = rows.groupBy("domain").agg(F.countDistinct("doc_id").alias("total")).where(F.col("total") >= least).orderBy(F.desc("total"), "domain").limit(limit)
    cells = rows.join(F.broadcast(top), "domain").groupBy("person_id", "domain", "total").agg(F.count(F.lit(1)).alias("docs"))
    return cells.select("person_id", "domain", "docs", round2(F.col("docs") / F.col("total")).alias("share"))


def comention(c: Corpus, scope: Scope, leans: dict[str, str] | None = None, least: int = 3) -> DataFrame:
    """(a, b, count) of persons named by the same documents, a before b."""
    rows = in_scope(c.docs, scope, leans).select("doc_id").join(c.doc_persons, "doc_id")
    a, b = rows.select("doc_id", F.col("person_id").alias("a")), rows.select("doc_id", F.col("person_id").alias("b"))
    return a.join(b, "doc_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)


def testimony(c: Corpus, scores: DataFrame, person: Person, days: int = 21, sources_: tuple[str, ...] | None = None, least: int = 3, at: str = ANCHOR) -> DataFrame:
    """Mean score overall, per source and per outlet of a source, from one pass of grouping sets.

    ``scores`` has (doc_id, person_id, score). Returns (level, source, domain,
    score, n); a mean without scores stays only at the overall level.
    """
    docs = since(c.docs, days, at)
    own = one_of(F.col("source"), sources_)
    docs = docs if own is None else docs.where(own)
    rows = docs.join(c.doc_persons.where(F.col("person_id") == person.id), "doc_id").join(scores, ["doc_id", "person_id"]).select("source", outlet_domain().alias("domain"), "score")
    rows = rows.groupingSets([[], ["source"], ["domain", "source"]], "source", "domain").agg(
        F.grouping("source").alias("gs"), F.grouping("domain").alias("gd"), round2(F.avg("score")).alias("score"), F.count("score").alias("n")
    )
    level = F.when((F.col("gs") == 1) & (F.col("gd") == 1), "overall").when(F.col("gd") == 1, "source").otherwise("domain")
    kept = (F.col("level") == "overall") | ((F.col("level") == "source") & (F.col("n") >= 1)) | ((F.col("level") == "domain") & F.col("domain").isNotNull() & (F.col("n") >= least))
    return rows.withColumn("level", level).where(kept).select("level", "source", "domain", "score", "n")


def term_testimony(c: Corpus, scores: DataFrame, person: Person, scope: Scope, keys: DataFrame, leans: dict[str, str] | None = None) -> DataFrame:
    """Mean score per wanted term over the person's scored documents, and the person's own mean as term null."""
    from liame.operators.terms import wanted_terms

    scored = about(c, in_scope(c.docs, scope, leans).select("doc_id"), person.id).join(scores.where((F.col("person_id") == person.id) & F.col("score").isNotNull()).select("doc_id", "score"), "doc_id")
    per = scored.join(c.doc_terms, "doc_id").join(wanted_terms(c, keys), "term_id").groupBy(F.col("name").alias("id")).agg(round2(F.avg("score")).alias("score"), F.count(F.lit(1)).alias("n"))
    whole = scored.agg(round2(F.avg("score")).alias("score"), F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("id"), "score", "n")
    return per.unionByName(whole)


def outlet_terms(c: Corpus, person: Person, scope: Scope, top: int = 40, floor: int = 3) -> DataFrame:
    """The best terms of every outlet about the person, ranked within the outlet."""
    docs = in_scope(c.docs, scope)
    mine = about(c, docs, person.id).select("doc_id", outlet_domain().alias("domain")).where("domain is not null and domain <> ''")
    counts = c.doc_terms.join(mine, "doc_id").groupBy("domain", "term_id").agg(F.count(F.lit(1)).alias("c_pt")).where(F.col("c_pt") >= floor)
    scored = (
        counts.join(c.terms, "term_id").where(~is_name(F.col("term"), person.tokens)).join(term_totals(c, tracked(c, docs)), "term_id")
        .crossJoin(F.broadcast(totals(c, docs, person)))
        .withColumn("key", rank(pmi(F.col("c_pt"), F.col("tracked"), F.col("about"), F.col("c_t")), F.col("c_pt")))
    )
    ranked = scored.withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("key"), "term", "kind")))
    return ranked.where(F.col("rn") <= top).select("domain", "kind", "term", "c_pt")


def jaccard(sets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a, b, similarity) of outlets that share a term, a before b; ``sets`` has distinct (keys, domain, kind, term)."""
    sizes = sets.groupBy(*keys, "domain").agg(F.count(F.lit(1)).alias("size"))
    a, b = sets.select(*keys, F.col("domain").alias("a"), "kind", "term"), sets.select(*keys, F.col("domain").alias("b"), "kind", "term")
    both = a.join(b, [*keys, "kind", "term"]).where("a < b").groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    sized = both.join(sizes.select(*keys, F.col("domain").alias("a"), F.col("size").alias("n_a")), [*keys, "a"]).join(sizes.select(*keys, F.col("domain").alias("b"), F.col("size").alias("n_b")), [*keys, "b"])
    return sized.select(*keys, "a", "b", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("similarity"))


def neighbours(edges: DataFrame, top: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """The ``top`` most similar outlets of each; ties by name."""
    both = edges.select(*keys, F.col("a").alias("domain"), F.col("b").alias("neighbor"), "similarity").unionByName(edges.select(*keys, F.col("b").alias("domain"), F.col("a").alias("neighbor"), "similarity"))
    w = Window.partitionBy(*keys, "domain").orderBy(F.desc("similarity"), "neighbor")
    return both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).select(*keys, "domain", "neighbor", "similarity", "rn")
