"""Answers from materialised aggregates where they hold the answer, else live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liame.corpus import Corpus, Person
from liame.functions.scoring import pmi
from liame.operators.scope import Scope, in_scope
from liame.operators.terms import nodes, scored_terms

WINDOWS = (7, 21)


def plain_scope(scope: Scope) -> bool:
    """Built windows of the default country, whatever the outlet."""
    return scope.days in WINDOWS and scope.domains is None and scope.leans is None and scope.country == "br"


def precomputable(scope: Scope) -> bool:
    """Built windows with at most one source and the default country."""
    return plain_scope(scope) and (scope.sources is None or len(scope.sources) == 1)


def stored_terms(graph_terms: DataFrame, graph_scopes: DataFrame, person: Person, scope: Scope) -> DataFrame:
    """The rows of ``scored_terms`` as the aggregates hold them."""
    source = "all" if scope.sources is None else scope.sources[0]
    of = lambda t: t.where((F.col("days") == scope.days) & (F.col("source") == source) & (F.col("person_id") == person.id))
    one = of(graph_scopes).select("tracked", "about")
    return of(graph_terms).crossJoin(F.broadcast(one)).select(
        "term", "kind", F.col("c_pt").alias("count"), "tone", "reach", pmi(F.col("c_pt"), F.col("tracked"), F.col("about"), F.col("c_t")).alias("pmi"), "about"
    )


def routed_nodes(c: Corpus, graph_terms: DataFrame | None, graph_scopes: DataFrame | None, person: Person, scope: Scope, leans: dict[str, str] | None = None, **options) -> DataFrame:
    """The term map; a window that was never built (a scope without terms for documents that exist) is answered live."""
    if graph_terms is not None and graph_scopes is not None and precomputable(scope):
        stored = stored_terms(graph_terms, graph_scopes, person, scope)
        source = "all" if scope.sources is None else scope.sources[0]
        row = graph_scopes.where((F.col("days") == scope.days) & (F.col("source") == source) & (F.col("person_id") == person.id)).select("about").first()
        if row is not None and (row["about"] == 0 or not stored.isEmpty()):
            return nodes(stored, **options)
    return nodes(scored_terms(c, in_scope(c.docs, scope, leans), person, person.tokens), **options)
