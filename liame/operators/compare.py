"""Two sides of one question: two persons in one scope, or one person through two lenses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liame.corpus import Corpus, Person
from liame.functions.scoring import is_name, pmi, rank, round2
from liame.operators.scope import Scope, in_scope, one_of
from liame.operators.terms import scored_terms, sided_counts
from liame.plans.lineage import cut


def _of_kind(rows: DataFrame, kinds: tuple[str, ...] | None) -> DataFrame:
    kind = one_of(F.col("kind"), kinds)
    return rows if kind is None else rows.where(kind)


def _figures(s: str, there: Column, count: Column, pmi_: Column, tone: Column) -> list[Column]:
    """One side's figures, null where it doesn't have the term; the raw ones order, the rounded ones are shown."""
    own = lambda x: F.when(there, x)
    return [own(count).alias(f"{s}_count"), own(pmi_).alias(f"_{s}_pmi"), own(tone).alias(f"_{s}_tone")]


def _best(rows: DataFrame, s: str, limit: int) -> list[DataFrame]:
    """One side's loudest and stickiest terms, with the figures of both."""
    there = rows.where(F.col(f"{s}_count").isNotNull())
    orders = (F.desc(f"{s}_count"), rank(F.col(f"_{s}_pmi"), F.col(f"{s}_count")).desc())
    return [there.orderBy(o, "term", "kind").limit(limit) for o in orders]


def _answer(parts: list[DataFrame], *more: str) -> DataFrame:
    """The union of the parts' terms; a term of several parts has the same figures in each."""
    shown = [c for s in "ab" for c in (F.col(f"{s}_count"), round2(F.col(f"_{s}_pmi")).alias(f"{s}_pmi"), round2(F.col(f"_{s}_tone")).alias(f"{s}_tone"))]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["term", "kind"]).select("term", "kind", *shown, *more)


def compare(c: Corpus, a: Person, b: Person, scope: Scope, kinds: tuple[str, ...] | None = None, limit: int = 40, leans: dict[str, str] | None = None) -> DataFrame:
    """The union of both persons' best terms with figures of both, in one universe.

    One aggregation counts both sides, so every term's row has both figures
    before any is chosen. Whether a term names an untracked person is unknown,
    so that side has no terms.
    """
    docs = in_scope(c.docs, scope, leans)
    counts, n = sided_counts(c, docs, [a, b])
    rows = _of_kind(counts.where("c_0 > 0 or c_1 > 0").join(c.terms, "term_id"), kinds).crossJoin(F.broadcast(n))
    named = [is_name(F.col("term"), p.tokens) if p.tracked else F.lit(None).cast("boolean") for p in (a, b)]
    figures = [
        x for i, s in enumerate("ab")
        for x in _figures(s, (F.col(f"c_{i}") > 0) & ~named[i], F.col(f"c_{i}"), pmi(F.col(f"c_{i}"), F.col("tracked"), F.col(f"n_{i}"), F.col("c_t")), F.col(f"tone_{i}"))
    ]
    rows = rows.select("term", "kind", *figures, named[0].alias("is_name_a"), named[1].alias("is_name_b"))
    rows = cut(rows)
    return _answer(_best(rows, "a", limit) + _best(rows, "b", limit), "is_name_a", "is_name_b")


def lenses(c: Corpus, person: Person, a: Scope, b: Scope, kinds: tuple[str, ...] | None = None, limit: int = 40, leans: dict[str, str] | None = None) -> DataFrame:
    """One person through two scopes, each its own universe; name terms compete among themselves."""
    sides = []
    for s, scope in zip("ab", (a, b)):
        rows = _of_kind(scored_terms(c, in_scope(c.docs, scope, leans), person, None), kinds)
        sides.append(rows.select("term", "kind", *_figures(s, F.lit(True), F.col("count"), F.col("pmi"), F.col("tone"))))
    rows = cut(sides[0].join(sides[1], ["term", "kind"], "full").withColumn("is_name", is_name(F.col("term"), person.tokens)))
    parts = [part for s in "ab" for part in _best(rows.where("not is_name"), s, limit)]
    parts += [rows.where(F.col("is_name") & F.col(f"{s}_count").isNotNull()).orderBy(F.desc(f"{s}_count"), "term", "kind").limit(limit) for s in "ab"]
    return _answer(parts, "is_name")


def bridge_candidates(rows: DataFrame, limit: int = 60) -> DataFrame:
    """The terms with most documents on both sides that are no names; (id, docs)."""
    docs = F.coalesce("a_count", F.lit(0)) + F.coalesce("b_count", F.lit(0))
    named = F.col("is_name") if "is_name" in rows.columns else F.col("is_name_a") | F.col("is_name_b")
    return rows.where(~named).select(F.concat_ws(":", "kind", "term").alias("id"), docs.alias("docs")).orderBy(F.desc("docs"), "id").limit(limit)
