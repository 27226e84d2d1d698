"""The answers of the engine's routes: from a parsed request to the relations that make up its answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liame import params as pr
from liame.corpus import Corpus, Person
from liame.operators import compare as cp
from liame.operators import documents as dc
from liame.operators import networks as nw
from liame.operators import outlets as ot
from liame.operators import series as sr
from liame.operators import terms as tm
from liame.operators.scope import Scope, about, in_scope, in_week, on_day, resolve_domains, with_person, with_term
from liame.plans.lineage import cut
from liame.plans.results import cached
from liame.plans.router import plain_scope, routed_nodes

Answer = dict[str, DataFrame]
SINCE = "2026-09-09"  # fixed value: from when on weekly history is complete


@dataclass(frozen=True)
class Extras:
    """What answers need besides the corpus; what is none is computed live or left out.

    scores (doc_id, person_id, method, score), views (person_id, day, views),
    the written aggregates, weekly history, and domain -> lean.
    """

    scores: DataFrame | None = None
    views: DataFrame | None = None
    graph_terms: DataFrame | None = None
    graph_scopes: DataFrame | None = None
    communities: DataFrame | None = None
    fields: DataFrame | None = None
    neighbors: DataFrame | None = None
    weeks: DataFrame | None = None
    leans: dict[str, str] = field(default_factory=dict)

    def scored(self, method: str) -> DataFrame:
        if self.scores is None:
            raise LookupError("no scores")
        return self.scores.where(F.col("method") == method)


def _spark(c: Corpus):
    return c.docs.sparkSession


def _leans(c: Corpus, x: Extras) -> DataFrame:
    return _spark(c).createDataFrame(sorted(x.leans.items()), "domain string, lean string")


def _outlets(c: Corpus, x: Extras, scope: Scope) -> DataFrame:
    """The outlets that a request's domains and leans leave; none if it names none."""
    domains = resolve_domains(scope, x.leans) or ()
    return _spark(c).createDataFrame([(d,) for d in domains], "domain string").join(_leans(c, x), "domain", "left")


def people(c: Corpus) -> Answer:
    shown = [k for k in ("party", "office", "uf") if k in c.persons.columns]
    return {"people": c.persons.select("id", "name", "aliases", *shown)}


def _persons(c: Corpus) -> DataFrame:
    return c.persons.select("id", "name")


def graph(c: Corpus, x: Extras, p: Person, q: pr.GraphQuery) -> Answer:
    """stats, nodes (with community and score if asked), links, signature, outlets."""
    docs = in_scope(c.docs, q.scope, x.leans)
    nodes = cut(routed_nodes(c, x.graph_terms, x.graph_scopes, p, q.scope, x.leans, sort=q.sort, kinds=q.kinds, least=q.least, limit=q.limit))
    keys, stats = nodes.select("kind", "term"), tm.totals(c, docs, p)
    star = nodes.select(F.lit(f"person:{p.id}").alias("s"), F.concat_ws(":", "kind", "term").alias("t"), "count")
    links = star.unionByName(tm.links(c, about(c, docs, p.id), keys))
    signature = tm.signature(tm.scored_terms(c, docs, p, p.tokens))
    if q.communities:
        source = "all" if q.scope.sources is None else q.scope.sources[0]
        if x.communities is not None and plain_scope(q.scope):
            own = x.communities.where((F.col("days") == q.scope.days) & (F.col("source") == source) & (F.col("person_id") == p.id)).select("node", "community")
            nodes = nodes.withColumn("node", F.concat_ws(":", "kind", "term")).join(own, "node", "left").drop("node")
        else:
            nodes = nodes.withColumn("community", F.lit(None).cast("int"))
    if q.method:
        means = cut(ot.term_testimony(c, x.scored(q.method), p, q.scope, keys, x.leans))
        per = means.where("id is not null").select("id", "score", "n")
        nodes = nodes.withColumn("id", F.concat_ws(":", "kind", "term")).join(per, "id", "left").drop("id")
        stats = stats.crossJoin(means.where("id is null").select("score", "n"))
    return {"stats": stats, "nodes": nodes, "links": links, "signature": signature, "outlets": _outlets(c, x, q.scope)}


def sources(c: Corpus, x: Extras, p: Person, q: pr.GraphQuery) -> Answer:
    """Outlets with lean, and, only for the universe that builds cover (all sources, domains and leans), field and neighbours."""
    rows = ot.sources(c, p, q.scope, x.leans)
    rows = rows.join(_leans(c, x), "domain", "left")
    built = plain_scope(q.scope) and q.scope.sources is None
    own = lambda t: t.where((F.col("days") == q.scope.days) & (F.col("person_id") == p.id))
    if built and x.fields is not None and x.neighbors is not None:
        near = own(x.neighbors).groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("rn", "neighbor", "similarity"))).alias("neighbors"))
        rows = rows.join(own(x.fields).select(F.col("node").alias("domain"), F.col("community").alias("field")), "domain", "left").join(near, "domain", "left")
    else:
        rows = rows.withColumn("field", F.lit(None).cast("int")).withColumn("neighbors", F.lit(None).cast("array<struct<rn:int,neighbor:string,similarity:double>>"))
    return {"sources": rows}


def docs(c: Corpus, x: Extras, p: Person, q: pr.DocsQuery) -> Answer:
    """total, page, outlets; an unknown person to stand beside narrows nothing."""
    rows = about(c, in_scope(c.docs, q.scope, x.leans), p.id)
    if q.term:
        rows = with_term(c, rows, q.term, q.kinds)
    if q.with_person and not c.persons.where(F.col("id") == q.with_person).isEmpty():
        rows = with_person(c, rows, q.with_person)
    rows = on_day(rows, q.day, q.scope.at) if q.day else in_week(rows, q.week, q.scope.at) if q.week else rows
    return {"total": dc.counted(rows), "page": dc.page(rows, q.limit, q.offset), "outlets": _outlets(c, x, q.scope)}


def timeline(c: Corpus, x: Extras, p: Person, q: pr.TimelineQuery) -> Answer:
    rows = about(c, in_scope(c.docs, q.scope, x.leans), p.id)
    rows = with_term(c, rows, q.term, q.kinds) if q.term else rows
    return {"timeline": sr.timeline(rows, q.scope.days, q.bucket_days, q.scope.at)}


def week(c: Corpus, x: Extras, p: Person, q: pr.WeekQuery) -> Answer:
    out = {"about": sr.week_about(c, p, q.scope, x.leans), "terms": sr.week_terms(c, p, q.scope, q.limit, q.kinds, x.leans)}
    if q.method:
        out["testimony"] = sr.week_testimony(c, x.scored(q.method), p, q.scope, x.leans)
    return out


def rising(c: Corpus, x: Extras, p: Person, q: pr.RisingQuery) -> Answer:
    """terms (by lift), present (by count), about (documents and words of both windows), outlets."""
    counts = cut(sr.rising_counts(c, p, q.scope, q.baseline, q.kinds, x.leans))
    rows = sr.rising(counts, q.scope.days, q.baseline, q.least)
    return {"terms": sr.lifted(rows, q.limit), "present": sr.present(rows, q.limit), "about": sr.rising_totals(c, counts, p, q.scope, q.baseline, x.leans), "outlets": _outlets(c, x, q.scope)}


def testimony(c: Corpus, x: Extras, p: Person, q: pr.FloorQuery) -> Answer:
    return {"testimony": ot.testimony(c, x.scored(q.method or "stub"), p, q.scope.days, q.scope.sources, q.least, q.scope.at)}


def _bridged(c: Corpus, rows: DataFrame, sides: list[DataFrame]) -> DataFrame:
    """``rows`` with each term's bridge between the sides' documents: 0 where it bridges nothing."""
    ids = cut(cp.bridge_candidates(rows, pr.BRIDGE_NODES)).select(F.substring_index("id", ":", 1).alias("kind"), F.expr("substring(id, instr(id, ':') + 1)").alias("term"))
    edges = tm.merged_edges(*[tm.links(c, side, ids) for side in sides])
    scored = nw.bridges(edges.withColumn("pair", F.lit(1)), ["pair"]).select("node", "bridge")
    return rows.withColumn("node", F.concat_ws(":", "kind", "term")).join(scored, "node", "left").withColumn("bridge", F.coalesce("bridge", F.lit(0.0))).drop("node")


def lenses(c: Corpus, x: Extras, p: Person, q: pr.PairQuery) -> Answer:
    """terms of one person through two lenses, bridges if asked, and how many documents each lens sees."""
    sides = [about(c, in_scope(c.docs, s, x.leans), p.id) for s in (q.a, q.b)]
    rows = cp.lenses(c, p, q.a, q.b, q.kinds, q.limit, x.leans)
    rows = _bridged(c, cut(rows), sides) if q.bridges else rows
    seen = [side.agg(F.count(F.lit(1)).alias(f"about_{s}")) for s, side in zip("ab", sides)]
    return {"terms": rows, "about": seen[0].crossJoin(seen[1])}


def compare(c: Corpus, x: Extras, a: Person, b: Person, q: pr.PairQuery) -> Answer:
    """terms of two persons in one scope, bridges if asked, and how many documents are about each."""
    scoped = in_scope(c.docs, q.a, x.leans)
    rows = cp.compare(c, a, b, q.a, q.kinds, q.limit, x.leans)
    sides = [about(c, scoped, p.id) for p in (a, b)]
    rows = _bridged(c, cut(rows), sides) if q.bridges else rows
    seen = [side.agg(F.count(F.lit(1)).alias(f"about_{s}")) for s, side in zip("ab", sides)]
    return {"terms": rows, "about": seen[0].crossJoin(seen[1])}


def attention(c: Corpus, x: Extras, p: Person, q: pr.FloorQuery) -> Answer:
    if x.views is None:
        raise LookupError("no page views")
    return {"series": sr.attention(x.views, p.id, q.scope.days, q.scope.at)}


def persistence(c: Corpus, x: Extras, p: Person, q: pr.PersistenceQuery) -> Answer:
    """terms in their total order, with the series of their weeks; and what the history covers."""
    history = (x.weeks if x.weeks is not None else sr.term_weeks(c, q.weeks)).where(F.col("person_id") == p.id)
    info = history.agg(F.min("week").alias("first_week")).withColumn("since", F.lit(SINCE).cast("date")).withColumn("horizon", F.lit(max(pr.DAYS)))
    return {"terms": sr.persistence(history, q.weeks, q.limit), "info": info}


def _domains(cells: DataFrame) -> DataFrame:
    return cells.select("domain").distinct()


def tone(c: Corpus, q: pr.FloorQuery) -> Answer:
    cells = ot.tone_matrix(c, q.scope.days, q.least, q.scope.at)
    return {"persons": _persons(c), "domains": _domains(cells), "cells": cells}


def agenda(c: Corpus, q: pr.FloorQuery) -> Answer:
    cells = ot.agenda(c, q.scope, q.least, q.limit or pr.AGENDA_LIMIT)
    return {"persons": _persons(c), "domains": _domains(cells), "cells": cells}


def candidates(c: Corpus, q: pr.FloorQuery) -> Answer:
    """Names with their counts, and up to three samples of each."""
    names = cut(dc.candidates(c, q.scope.days, q.least, q.limit or 50, q.scope.at))
    return {"names": names, "samples": dc.candidate_samples(c, names.select("name"), q.scope.days, at=q.scope.at)}


def comention(c: Corpus, x: Extras, q: pr.FloorQuery) -> Answer:
    return {"persons": _persons(c), "pairs": ot.comention(c, q.scope, x.leans, q.least)}


OF_PERSON: dict[str, tuple[Callable, Callable]] = {
    "graph": (pr.graph, graph), "sources": (pr.graph, sources), "timeline": (pr.timeline, timeline), "week": (pr.week, week), "rising": (pr.rising, rising),
    "testimony": (pr.testimony, testimony), "lenses": (pr.lenses, lenses), "attention": (pr.attention, attention), "persistence": (pr.persistence, persistence),
}
OF_ALL: dict[str, tuple[Callable, Callable]] = {
    "tone": (pr.tone, lambda c, x, q: tone(c, q)), "agenda": (pr.agenda, lambda c, x, q: agenda(c, q)), "candidates": (pr.candidates, lambda c, x, q: candidates(c, q)), "comention": (pr.comention, comention),
}


def warmed(c: Corpus, root: str, build: str, route: str, relation: str, raw: pr.Raw, x: Extras = Extras(), person_id: str | None = None) -> DataFrame:
    """A relation of an answer from the results stored for a build, made and stored if they lack it; requests that parse alike share one."""
    parse = (OF_PERSON | OF_ALL).get(route, (lambda raw: tuple(sorted(raw.items())), None))[0]
    asked = {"person": person_id, "relation": relation, "query": repr(parse(raw))}
    return cached(c.docs.sparkSession, root, build, route, asked, lambda: answer(c, route, raw, x, person_id)[relation])


def answer(c: Corpus, route: str, raw: pr.Raw, x: Extras = Extras(), person_id: str | None = None) -> Answer:
    """The relations of a route's answer to a raw request; LookupError for an unknown route or person."""
    if route == "people":
        return people(c)
    if route in OF_ALL:
        parse, make = OF_ALL[route]
        return make(c, x, parse(raw))
    if route == "compare":
        return compare(c, x, c.person(raw.get("a", "").strip()), c.person(raw.get("b", "").strip()), pr.compare(raw))
    p = c.person(person_id or "")
    if route == "docs":
        return docs(c, x, p, pr.docs(raw, p.id))
    if route not in OF_PERSON:
        raise LookupError(f"no route {route}")
    parse, make = OF_PERSON[route]
    return make(c, x, p, parse(raw))
