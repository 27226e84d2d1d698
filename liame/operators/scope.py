"""Which documents a question is about."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liame.clock import ANCHOR, before, folded_day
from liame.corpus import Corpus

KINDS = ("hashtag", "word", "phrase", "org")


@dataclass(frozen=True)
class Scope:
    """A window back from the anchor, open towards the future, and categorical filters.

    ``sources`` and ``domains``: None for all; an empty tuple matches nothing.
    ``leans`` narrows to the domains so labelled. ``country``: br (keeps
    documents without country), pt, or all.
    """

    days: int = 21
    sources: tuple[str, ...] | None = None
    domains: tuple[str, ...] | None = None
    leans: tuple[str, ...] | None = None
    country: str = "br"
    at: str = ANCHOR


def one_of(column: Column, values: tuple[str, ...] | None) -> Column | None:
    if values is None:
        return None
    return column.isin(list(values)) if values else F.lit(False)


def country_filter(country: str) -> Column | None:
    if country == "br":
        return ~F.col("country").eqNullSafe(F.lit("pt"))
    return F.col("country") == "pt" if country == "pt" else None


def outlet_domain() -> Column:
    """A microblog's domain is an account, no outlet."""
    return F.when(F.col("source") == "bluesky", F.lit(None).cast("string")).otherwise(F.col("domain"))


def resolve_domains(scope: Scope, leans: dict[str, str]) -> tuple[str, ...] | None:
    """Domains that the scope's domains and leans leave; an empty intersection matches nothing."""
    if scope.leans is None:
        return scope.domains
    labelled = [d for d, lean in sorted(leans.items()) if lean in scope.leans]
    return tuple(d for d in labelled if scope.domains is None or d in scope.domains)


DAY = "published_day"  # partition column of stored documents


def since(docs: DataFrame, days: int, at: str = ANCHOR) -> DataFrame:
    """Documents of the last ``days``; stored ones are read from their days' files only."""
    docs = docs.where(F.col("published_at") >= before(days, at))
    return docs.where(F.col(DAY) >= F.to_date(before(days, at))) if DAY in docs.columns else docs


def in_scope(docs: DataFrame, scope: Scope, leans: dict[str, str] | None = None) -> DataFrame:
    """Documents in scope; only filters that are set reach the plan, so they reach the scan."""
    docs = since(docs, scope.days, scope.at)
    for condition in (
        one_of(F.col("source"), scope.sources),
        one_of(F.col("domain"), resolve_domains(scope, leans or {})),
        country_filter(scope.country),
    ):
        if condition is not None:
            docs = docs.where(condition)
    return docs


def about(c: Corpus, docs: DataFrame, person_id: str) -> DataFrame:
    """The documents of ``docs`` that name the person."""
    return docs.join(c.doc_persons.where(F.col("person_id") == person_id).select("doc_id"), "doc_id")


def tracked(c: Corpus, docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` that name any person; the universe of association figures."""
    return docs.join(c.doc_persons.select("doc_id"), "doc_id", "left_semi")


def with_term(c: Corpus, docs: DataFrame, term: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Documents that hold a term; kinds that hold an unknown one are ignored. A document under two kinds counts once."""
    wanted = c.terms.where(F.col("term") == term)
    if kinds is not None and set(kinds) <= set(KINDS):
        wanted = wanted.where(one_of(F.col("kind"), kinds))
    return docs.join(c.doc_terms.join(wanted.select("term_id"), "term_id").select("doc_id"), "doc_id", "left_semi")


def with_person(c: Corpus, docs: DataFrame, person_id: str) -> DataFrame:
    return docs.join(c.doc_persons.where(F.col("person_id") == person_id).select("doc_id"), "doc_id", "left_semi")


def on_day(docs: DataFrame, day: str, at: str = ANCHOR) -> DataFrame:
    return docs.where(folded_day(F.col("published_at"), at) == F.lit(day).cast("date"))


def in_week(docs: DataFrame, monday: str, at: str = ANCHOR) -> DataFrame:
    day, first = folded_day(F.col("published_at"), at), F.lit(monday).cast("date")
    return docs.where((day >= first) & (day < F.date_add(first, 7)))
