"""The engine's queries over the tables of a folder, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liame import params as pr
from liame.clock import local_day
from liame.corpus import Corpus, Person
from liame.functions import text as tx
from liame.functions import windows as wn
from liame.functions.scoring import round2
from liame.operators import compare as cp
from liame.operators import documents as dc
from liame.operators import extract as ex
from liame.operators import networks as nw
from liame.operators import outlets as ot
from liame.operators import post as po
from liame.operators import routes as rs
from liame.operators import series as sr
from liame.operators import terms as tm
from liame.operators.scope import Scope, about, in_scope, in_week, on_day, tracked, with_person, with_term
from liame.oracles import SQL
from liame.oracles_routes import SQL as ROUTES
from liame.plans import build as bd
from liame.plans import maintenance as mt
from liame.plans import router as rt
from liame.plans.layout import once, opened, served
from liame.plans.lineage import cut
from liame.streaming import ingest as ig

A, B = "jose-nhusabise", "frederico-vivedim-nhisubuta"
LEANS = {"folhetimselhapuce.pt": "left", "gazetaficagece.jor.br": "right", "jornalgalhunoce.jor.br": "center", "diariotrunhimice.jor.br": "left", "correiorobelice.jor.br": "right"}
WINDOW, WEEK = Scope(21), Scope(7)
ARRIVAL = ["collected_at", "doc_id"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
OF_CORPUS: dict[str, Callable[[Corpus], DataFrame]] = {}
ORACLES: dict[str, str] = SQL | ROUTES


def query(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    """Registers a function of the corpus as a query under its name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return f(served(spark, folder))

    QUERIES[f.__name__], OF_CORPUS[f.__name__] = run, f
    return f


def leans(c: Corpus) -> DataFrame:
    return c.docs.sparkSession.createDataFrame(sorted(LEANS.items()), "domain string, lean string")


def scores(c: Corpus) -> DataFrame:
    """Stand-in testimony: a figure of ids alone, null for every fifth pair, so that SQL can say it too."""
    x = F.col("doc_id") * 7 + F.length("person_id") * 13
    score = F.when((F.col("doc_id") + F.length("person_id")) % 5 == 0, None).otherwise((x % 21 - 10).cast("double"))
    return c.doc_persons.select("doc_id", "person_id", score.alias("score"))


def views(c: Corpus) -> DataFrame:
    """Stand-in daily series: documents per person and local day."""
    docs = c.docs.select("doc_id", local_day(F.col("published_at")).alias("day"))
    return c.doc_persons.join(docs, "doc_id").groupBy("person_id", "day").agg((F.count(F.lit(1)) * 100).alias("views"))


def mine(c: Corpus, scope: Scope = WINDOW, who: str = A) -> DataFrame:
    return about(c, in_scope(c.docs, scope, LEANS), who)


def top_keys(c: Corpus, p: Person, limit: int = 40) -> DataFrame:
    return tm.graph_nodes(c, p, WINDOW, limit=limit).select("kind", "term")


@query
def people(c: Corpus) -> DataFrame:
    return c.persons.select("id", "name", F.size("aliases").cast("long").alias("n_aliases"), "party", "office", "uf")


@query
def pmi_nodes(c: Corpus) -> DataFrame:
    return tm.graph_nodes(c, c.person(A), WINDOW, sort="count")


@query
def pmi_nodes_by_surprise(c: Corpus) -> DataFrame:
    return tm.graph_nodes(c, c.person(A), WINDOW, sort="pmi", least=3)


@query
def pmi_nodes_of_kind(c: Corpus) -> DataFrame:
    return tm.graph_nodes(c, c.person(A), Scope(21, sources=("rss", "gnews")), kinds=("word", "org"), limit=60)


@query
def term_counts(c: Corpus) -> DataFrame:
    p = c.person(A)
    return tm.term_counts(c, mine(c), p.tokens).select("kind", "term", "c_pt", round2(F.col("tone")).alias("tone"), "reach")


@query
def term_totals(c: Corpus) -> DataFrame:
    return tm.term_totals(c, tracked(c, in_scope(c.docs, WINDOW))).join(c.terms, "term_id").select("kind", "term", "c_t")


@query
def scope_stats(c: Corpus) -> DataFrame:
    return tm.totals(c, in_scope(c.docs, WINDOW), c.person(A))


@query
def signature_top5(c: Corpus) -> DataFrame:
    p = c.person(A)
    return tm.signature(tm.scored_terms(c, in_scope(c.docs, WINDOW), p, p.tokens))


@query
def cooccurrence_links(c: Corpus) -> DataFrame:
    return tm.links(c, mine(c), top_keys(c, c.person(A)))


@query
def star_links(c: Corpus) -> DataFrame:
    p = c.person(A)
    return tm.star(p, tm.graph_nodes(c, p, WINDOW))


@query
def induced_links(c: Corpus) -> DataFrame:
    p = c.person(A)
    names = top_keys(c, p, 20).select(F.concat_ws(":", "kind", "term").alias("name"))
    return tm.induced(tm.links(c, mine(c), top_keys(c, p)), names)


@query
def edge_merge(c: Corpus) -> DataFrame:
    keys = top_keys(c, c.person(A))
    return tm.merged_edges(tm.links(c, mine(c), keys), tm.links(c, mine(c, who=B), keys))


@query
def related_terms(c: Corpus) -> DataFrame:
    edges = tm.links(c, mine(c), top_keys(c, c.person(A)))
    return po.related(edges, "word:governo")


@query
def sources_by_outlet(c: Corpus) -> DataFrame:
    return ot.sources(c, c.person(A), WINDOW)


@query
def sources_labelled(c: Corpus) -> DataFrame:
    return ot.labelled(ot.sources(c, c.person(A), WINDOW).select("domain", "source", "docs"), leans(c))


@query
def tone_matrix(c: Corpus) -> DataFrame:
    return ot.tone_matrix(c)


@query
def agenda_share(c: Corpus) -> DataFrame:
    return ot.agenda(c, WINDOW)


@query
def agenda_pivot(c: Corpus) -> DataFrame:
    return po.agenda_rows(ot.agenda(c, WINDOW), [A, B]).select("domain", F.col(f"`{A}`").alias("share_a"), F.col(f"`{B}`").alias("share_b"))


@query
def comention_pairs(c: Corpus) -> DataFrame:
    return ot.comention(c, WINDOW)


@query
def comention_matrix(c: Corpus) -> DataFrame:
    return po.comention_matrix(ot.comention(c, WINDOW))


@query
def testimony_grouping_sets(c: Corpus) -> DataFrame:
    return ot.testimony(c, scores(c), c.person(A))


@query
def term_testimony(c: Corpus) -> DataFrame:
    p = c.person(A)
    return ot.term_testimony(c, scores(c), p, WINDOW, top_keys(c, p))


@query
def candidates(c: Corpus) -> DataFrame:
    return dc.candidates(c)


@query
def candidate_samples(c: Corpus) -> DataFrame:
    return dc.candidate_samples(c, dc.candidates(c).select("name"))


@query
def docs_page(c: Corpus) -> DataFrame:
    return dc.page(mine(c), 50, 50)


@query
def docs_count(c: Corpus) -> DataFrame:
    return dc.counted(mine(c))


@query
def docs_by_term(c: Corpus) -> DataFrame:
    return dc.page(with_term(c, mine(c), "governo", ("word", "phrase")))


@query
def docs_with_entity(c: Corpus) -> DataFrame:
    return with_person(c, mine(c), B).select("doc_id", "source", "uri")


@query
def docs_by_day(c: Corpus) -> DataFrame:
    return on_day(mine(c), "2026-08-31").select("doc_id", "source")


@query
def docs_by_week(c: Corpus) -> DataFrame:
    return in_week(mine(c), "2026-08-24").select("doc_id", "source")


@query
def country_filter(c: Corpus) -> DataFrame:
    one = lambda k: in_scope(c.docs, Scope(21, country=k)).agg(F.lit(k).alias("country"), F.count(F.lit(1)).alias("docs"))
    return one("br").unionByName(one("pt")).unionByName(one("all"))


@query
def lean_filter(c: Corpus) -> DataFrame:
    scope = Scope(21, domains=("gazetaficagece.jor.br", "folhetimselhapuce.pt", "jornalgalhunoce.jor.br"), leans=("left", "center"), country="all")
    return in_scope(c.docs, scope, LEANS).groupBy("domain").agg(F.count(F.lit(1)).alias("docs"))


@query
def attention_series(c: Corpus) -> DataFrame:
    return sr.attention(views(c), A)


@query
def peak_day(c: Corpus) -> DataFrame:
    return po.peak_day(sr.attention(views(c), A))


@query
def peak_lag(c: Corpus) -> DataFrame:
    return po.lag_days(sr.attention(views(c), A), sr.attention(views(c), B))


@query
def compare_entities(c: Corpus) -> DataFrame:
    return cp.compare(c, c.known_or_not(A), c.known_or_not(B), WINDOW)


@query
def lenses(c: Corpus) -> DataFrame:
    return cp.lenses(c, c.person(A), Scope(21, sources=("rss",)), Scope(21, sources=("gnews",)))


@query
def bridge_candidates(c: Corpus) -> DataFrame:
    return cp.bridge_candidates(cp.compare(c, c.known_or_not(A), c.known_or_not(B), WINDOW))


@query
def ruler_balance(c: Corpus) -> DataFrame:
    rows = cp.compare(c, c.known_or_not(A), c.known_or_not(B), WINDOW)
    return rows.select("term", "kind", po.balance(F.col("a_pmi"), F.col("b_pmi")).alias("balance"))


def _rising(c: Corpus) -> tuple[DataFrame, DataFrame]:
    counts = sr.rising_counts(c, c.person(A), WEEK)
    return counts, sr.rising(counts)


@query
def rising_terms(c: Corpus) -> DataFrame:
    return sr.lifted(_rising(c)[1])


@query
def rising_present(c: Corpus) -> DataFrame:
    return sr.present(_rising(c)[1])


@query
def rising_totals(c: Corpus) -> DataFrame:
    return sr.rising_totals(c, _rising(c)[0], c.person(A), WEEK)


@query
def rare_risers(c: Corpus) -> DataFrame:
    rows = _rising(c)[1]
    return po.rare_risers(sr.lifted(rows), sr.present(rows)).select("term", "kind", "lift")


@query
def share_balance(c: Corpus) -> DataFrame:
    counts, rows = _rising(c)
    words = sr.rising_totals(c, counts, c.person(A), WEEK)
    figure = po.share_balance(F.col("count_recent_raw"), F.col("words_recent"), F.col("count_baseline_raw"), F.col("words_baseline"))
    return rows.crossJoin(F.broadcast(words)).select("term", "kind", F.round(figure, 6).alias("balance"))


@query
def lift_balance(c: Corpus) -> DataFrame:
    counts, rows = _rising(c)
    own = sr.rising_totals(c, counts, c.person(A), WEEK).select(po.lift_of_person(F.col("about_recent"), 7, F.col("about_baseline"), 14).alias("own"))
    return rows.crossJoin(F.broadcast(own)).select("term", "kind", F.round(po.lift_balance(F.col("lift"), F.col("own")), 6).alias("balance"))


@query
def timeline_week(c: Corpus) -> DataFrame:
    return sr.timeline(mine(c))


@query
def timeline_day(c: Corpus) -> DataFrame:
    return sr.timeline(mine(c), 21, 1)


@query
def timeline_term(c: Corpus) -> DataFrame:
    return sr.timeline(with_term(c, mine(c), "governo"), 21, 1)


@query
def week_about(c: Corpus) -> DataFrame:
    return sr.week_about(c, c.person(A), WEEK)


@query
def week_terms(c: Corpus) -> DataFrame:
    return sr.week_terms(c, c.person(A), WEEK)


@query
def week_testimony(c: Corpus) -> DataFrame:
    return sr.week_testimony(c, scores(c), c.person(A), WEEK)


@query
def term_weeks(c: Corpus) -> DataFrame:
    return sr.term_weeks(c, tokens=bd.person_tokens(c))


def _persistence(c: Corpus) -> DataFrame:
    return sr.persistence(sr.term_weeks(c, weeks=12, tokens=bd.person_tokens(c)), 12, None)


@query
def persistence_stats(c: Corpus) -> DataFrame:
    return _persistence(c).select("person_id", "term", "kind", "streak", "half_life", "weeks_present", "total")


@query
def persistence_series(c: Corpus) -> DataFrame:
    return _persistence(c).select("person_id", "term", "kind", F.posexplode("series").alias("slot", "count")).withColumn("slot", F.col("slot").cast("long"))


@query
def persistence_level(c: Corpus) -> DataFrame:
    rows = sr.term_weeks(c, tokens=bd.person_tokens(c)).where(F.col("person_id") == A)
    top = rows.agg(F.max("count").alias("top"))
    return rows.crossJoin(F.broadcast(top)).select("term", "kind", "week", po.level(F.col("count"), F.col("top")).alias("level"))


@query
def normalize_text(c: Corpus) -> DataFrame:
    return c.docs.select("doc_id", tx.folded(F.col("text")).alias("folded"))


@query
def hashtags(c: Corpus) -> DataFrame:
    return ex.hashtag_rows(c.docs)


@query
def content_words(c: Corpus) -> DataFrame:
    return ex.word_rows(c.docs)


@query
def decode_entities(c: Corpus) -> DataFrame:
    return tx.decoded(c.docs.select("doc_id", "text"))


@query
def word_pairs(c: Corpus) -> DataFrame:
    return ex.pair_stage(c.docs)


@query
def phrase_lexicon(c: Corpus) -> DataFrame:
    return ex.phrase_lexicon(ex.pair_stage(c.docs))


@query
def collocations(c: Corpus) -> DataFrame:
    return ex.collocations(ex.pair_stage(c.docs), c.phrases)


@query
def doc_terms_build(c: Corpus) -> DataFrame:
    return ex.term_rows(c.docs, c.phrases)


@query
def proper_nouns(c: Corpus) -> DataFrame:
    return c.docs.where("text is not null").select("doc_id", F.explode(F.array_distinct(tx.proper_nouns_of("text"))).alias("term"))


@query
def entity_tagging(c: Corpus) -> DataFrame:
    return ex.mention_rows(c.docs, c.persons)


@query
def untracked_names(c: Corpus) -> DataFrame:
    return ex.name_rows(c.docs, c.persons)


@query
def domain_of(c: Corpus) -> DataFrame:
    return c.docs.select("doc_id", tx.domain_of(F.col("uri")).alias("domain"))


@query
def country_of(c: Corpus) -> DataFrame:
    return c.docs.select("doc_id", tx.country_of(F.col("domain")).alias("country"))


@query
def truncate_text(c: Corpus) -> DataFrame:
    return c.docs.select("doc_id", tx.truncate(F.col("text"), 200).alias("text"))


@query
def build_universe(c: Corpus) -> DataFrame:
    return bd.universe(c, 21).join(c.terms, "term_id").select("source", "kind", "term", "c_t")


@query
def build_scopes(c: Corpus) -> DataFrame:
    return bd.scopes(c, 21)


@query
def build_person_terms(c: Corpus) -> DataFrame:
    return bd.person_terms(c, 21).select("days", "source", "person_id", "term", "kind", "c_pt", "c_t", round2(F.col("tone")).alias("tone"), "reach")


def aggregates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(graph_terms, graph_scopes) of a folder, written once and read from there."""
    path = once(spark, folder, "aggregates", lambda path: bd.write_aggregates(served(spark, folder), path))
    return opened(spark, path, lambda spark, path: (bd.read_window(spark, f"{path}/graph_terms"), bd.read_window(spark, f"{path}/graph_scopes")))


def fast_nodes(spark: SparkSession, folder: str) -> DataFrame:
    c = served(spark, folder)
    return rt.routed_nodes(c, *aggregates(spark, folder), c.person(A), WINDOW, sort="pmi")


def fast_equals_live(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in which the stored and the live map of a person differ: none."""
    c = served(spark, folder)
    p = c.known_or_not(B)
    fast = tm.nodes(rt.stored_terms(*aggregates(spark, folder), p, WINDOW), sort="pmi", limit=100)
    live = tm.graph_nodes(c, p, WINDOW, sort="pmi", limit=100)
    return fast.exceptAll(live).unionByName(live.exceptAll(fast)).select("term", "kind", "count")


def stored_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """The scopes of one window as they were written."""
    rows = aggregates(spark, folder)[1].where("days = 21")
    return rows.select(F.col("days").cast("long").alias("days"), "source", "person_id", "docs", "tracked", "about")


def stored_person_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The person terms of one window as they were written."""
    rows = aggregates(spark, folder)[0].where("days = 21")
    return rows.select(F.col("days").cast("long").alias("days"), "source", "person_id", "term", "kind", "c_pt", "c_t", round2(F.col("tone")).alias("tone"), "reach")


QUERIES |= {f.__name__: f for f in (fast_nodes, fast_equals_live, stored_scopes, stored_person_terms)}


@query
def outlet_terms(c: Corpus) -> DataFrame:
    return ot.outlet_terms(c, c.person(A), WINDOW)


@query
def outlet_jaccard(c: Corpus) -> DataFrame:
    return ot.jaccard(ot.outlet_terms(c, c.person(A), WINDOW))


@query
def outlet_neighbors(c: Corpus) -> DataFrame:
    return ot.neighbours(ot.jaccard(ot.outlet_terms(c, c.person(A), WINDOW))).withColumn("rn", F.col("rn").cast("long"))


@query
def outlet_fields(c: Corpus) -> DataFrame:
    sets = ot.outlet_terms(c, c.person(A), WINDOW)
    nodes = sets.select(F.lit(A).alias("person_id"), F.col("domain").alias("node")).distinct()
    edges = ot.jaccard(sets).select(F.lit(A).alias("person_id"), F.col("a").alias("s"), F.col("b").alias("t"), F.col("similarity").alias("count"))
    return nw.communities(nodes, edges, ["person_id"])


@query
def build_outlet_terms(c: Corpus) -> DataFrame:
    """Of every person in both windows, as the next two; ``outlet_terms`` and its kin are the request for one."""
    first, second = (bd.outlet_terms(c, days) for days in bd.DAYS)
    return first.unionByName(second)


@query
def build_outlet_neighbors(c: Corpus) -> DataFrame:
    return bd.outlet_networks(c)[0].withColumn("rn", F.col("rn").cast("long"))


@query
def build_outlet_fields(c: Corpus) -> DataFrame:
    return bd.outlet_networks(c)[1]


GRAPH = ("days", "source", "person_id")


@query
def term_communities(c: Corpus) -> DataFrame:
    return nw.communities(*bd.kept_graphs(c), [*GRAPH])


@query
def community_ranking(c: Corpus) -> DataFrame:
    nodes, edges = bd.kept_graphs(c, days=(WINDOW.days,), sources=("all",), person_id=A)
    return po.community_ranking(nw.communities(nodes, edges, [*GRAPH]))


@query
def node_scores(c: Corpus) -> DataFrame:
    """What the map may be sorted by."""
    p = c.person(A)
    rows = tm.scored_terms(c, in_scope(c.docs, WINDOW), p, p.tokens)
    return rows.select("kind", "term", *[F.round(po.score(s), 6).alias(f"by_{s}") for s in ("count", "pmi", "reach")])


@query
def score_confusion(c: Corpus) -> DataFrame:
    """The stand-in scores held against a label of ids."""
    rows = scores(c).select("score", (F.col("doc_id") % 2 == 0).alias("label")).where("score is not null")
    return po.confusion(rows, 3.0)


@query
def persons_upsert(c: Corpus) -> DataFrame:
    incoming = c.persons.where("uf is null").select("id", F.upper("name").alias("name"), "aliases", "wikipedia", F.lit("x").alias("party"), "office", "uf")
    return ig.upsert_persons(c.persons, incoming).select("id", "name", "party")


@query
def persons_prune(c: Corpus) -> DataFrame:
    return ig.pruned(c.persons, c.doc_persons, c.persons.where("party is not null").select("id"))[1].select("doc_id", "person_id")


@query
def legacy_terms(c: Corpus) -> DataFrame:
    """Terms written in full beside their documents, turned into a dictionary and a junction, and read again."""
    old = c.doc_terms.join(c.terms, "term_id").select("doc_id", "kind", "term")
    terms, doc_terms = ex.dictionary(old)
    return doc_terms.join(terms, "term_id").groupBy("kind", "term").agg(F.count(F.lit(1)).alias("docs"))


@query
def result_hash(c: Corpus) -> DataFrame:
    """Whether the digest of a result depends on its rows and not on their order."""
    rows = c.persons.select("id", "name", "party")
    a, b, other = (mt.result_hash(x) for x in (rows.orderBy("id"), rows.orderBy(F.desc("name")), rows.where("party is not null")))
    return a.join(b, ["rows", "digest"], "left_semi").select("rows", F.lit(other.first() != a.first()).alias("differs"))


@query
def bridges(c: Corpus) -> DataFrame:
    keys = top_keys(c, c.person(A))
    edges = tm.merged_edges(tm.links(c, mine(c), keys), tm.links(c, mine(c, who=B), keys))
    return nw.bridges(edges.withColumn("pair", F.lit("a/b")), ["pair"])


@query
def fold_testimony(c: Corpus) -> DataFrame:
    rows = ot.testimony(c, scores(c), c.person(A)).where("level = 'domain'")
    return po.fold_testimony(rows).withColumn("score", F.round("score", 6))


@query
def merge_outlets(c: Corpus) -> DataFrame:
    rows = po.fold_testimony(ot.testimony(c, scores(c), c.person(A)).where("level = 'domain'"))
    return po.merge_outlets(ot.sources(c, c.person(A), WINDOW).select("domain", "source", "docs"), rows.withColumn("score", F.round("score", 6)))


@query
def testimony_class(c: Corpus) -> DataFrame:
    rows = ot.testimony(c, scores(c), c.person(A)).where("level = 'domain'")
    return rows.select("domain", "source", po.testimony_class(F.col("score")).alias("verdict"))


@query
def term_mask(c: Corpus) -> DataFrame:
    p = c.person(A)
    rows = ot.term_testimony(c, scores(c), p, WINDOW, top_keys(c, p))
    own = rows.where("id is null").select(F.col("score").alias("own"))
    return po.term_mask(rows.where("id is not null").crossJoin(F.broadcast(own)), F.col("own")).select("id", F.round("mask", 6).alias("mask"), "n")


@query
def tone_percentiles(c: Corpus) -> DataFrame:
    return po.percentiles(c.docs.where("tone is not null"), "tone")


@query
def uri_layers(c: Corpus) -> DataFrame:
    return ig.layers(c.docs, ARRIVAL).select("uri", "doc_id", F.col("layer").cast("long").alias("layer"))


@query
def merge_longest_text(c: Corpus) -> DataFrame:
    return ig.merged(c.docs, ARRIVAL).select("uri", "doc_id", "source", "text", "domain", "country", "tone", "arrivals", "enriched")


@query
def reach_max(c: Corpus) -> DataFrame:
    return ig.merged(c.docs, ARRIVAL).select("uri", *ig.REACH)


@query
def retention_trim(c: Corpus) -> DataFrame:
    docs = ig.retained(c.docs, 14)
    return ig.cascade(c.doc_persons, docs)


@query
def tracked_only(c: Corpus) -> DataFrame:
    return ig.naming_someone(c.docs, c.doc_persons).select("doc_id", "source")


@query
def purge_source(c: Corpus) -> DataFrame:
    return ig.cascade(c.doc_terms, ig.without_source(c.docs, "gkg"))


@query
def purge_kind(c: Corpus) -> DataFrame:
    return ig.without_kind(c.docs, "org").select("doc_id", F.size("extra_terms").cast("long").alias("n_extra"))


@query
def orphan_terms(c: Corpus) -> DataFrame:
    return ig.orphan_terms(c.terms, c.doc_terms)


@query
def backfill(c: Corpus) -> DataFrame:
    return ig.backfilled(c.docs).select("doc_id", "domain", "country", F.length("text").cast("long").alias("n_chars"))


@query
def unscored_pairs(c: Corpus) -> DataFrame:
    done = scores(c).where("doc_id % 3 = 0").withColumn("method", F.lit("stub"))
    return ex.unscored(c.doc_persons, done, "stub")


@query
def stub_scores(c: Corpus) -> DataFrame:
    return ex.scored(c.doc_persons, c.docs)


@query
def token_sizes(c: Corpus) -> DataFrame:
    return wn.token_sizes(c.docs)


@query
def scored_texts(c: Corpus) -> DataFrame:
    return ex.scored_texts(c.doc_persons, c.docs, c.persons, 64)


@query
def export_docs(c: Corpus) -> DataFrame:
    return ex.exported(c.docs, c.doc_persons).select("doc_id", "source", "uri", F.array_join("persons", ",").alias("persons"))


# The routes, asked with parameters other than their defaults.
GRAPH_ASKED = {"days": "7", "kind": "word,phrase", "min": "2", "sort": "pmi", "limit": "20", "testimony": "1", "country": "all"}
LEFT = {"days": "7", "lean": "left,right", "country": "all"}


def extras(spark: SparkSession, folder: str) -> rs.Extras:
    """Scores, views and leans of the test tables, with the aggregates that are written for them."""
    c = served(spark, folder)
    terms, scopes = aggregates(spark, folder)
    path = once(spark, folder, "networks", lambda path: bd.write_networks(served(spark, folder), path))
    near, fields, communities = opened(spark, path, lambda spark, path: [bd.read_window(spark, f"{path}/{n}") for n in ("outlet_neighbors", "outlet_fields", "term_communities")])
    path = once(spark, folder, "weeks", lambda path: bd.write_weeks(sr.term_weeks(served(spark, folder), 12, tokens=bd.person_tokens(c)), path))
    weeks = opened(spark, path, bd.read_window)
    return rs.Extras(scores(c).withColumn("method", F.lit("stub")), views(c), terms, scopes, communities, fields, near, weeks, LEANS)


def _asked(route: str, relation: str, raw: dict[str, str], shown: Callable[[DataFrame], DataFrame] | None = None, person: str = A) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = rs.answer(served(spark, folder), route, raw, extras(spark, folder), person)[relation]
        return shown(rows) if shown else rows

    return run


def _compared(relation: str, raw: dict[str, str], shown: Callable[[DataFrame], DataFrame] | None = None) -> Query:
    """The answer of compare to a fixed question; the route refuses a person that the tables lack, here that side is empty."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        c = served(spark, folder)
        rows = rs.compare(c, extras(spark, folder), c.known_or_not(raw["a"]), c.known_or_not(raw["b"]), pr.compare(raw))[relation]
        return shown(rows) if shown else rows

    return run


def _joined(column: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.withColumn(column, F.array_join(column, ","))


QUERIES |= {
    "route_people": _asked("people", "people", {}, _joined("aliases")),
    "route_graph_stats": _asked("graph", "stats", GRAPH_ASKED),
    "route_graph_nodes": _asked("graph", "nodes", GRAPH_ASKED),
    "route_graph_links": _asked("graph", "links", GRAPH_ASKED),
    "route_graph_signature": _asked("graph", "signature", GRAPH_ASKED),
    "route_graph_outlets": _asked("graph", "outlets", LEFT),
    "route_graph_communities": _asked("graph", "nodes", {"communities": "1", "limit": "200"}, lambda rows: rows.where("community is not null").select("kind", "term")),
    "route_sources": _asked("sources", "sources", {}, lambda rows: rows.withColumn("neighbors", F.array_join("neighbors.neighbor", ",")).drop("field")),
    "route_sources_lean": _asked("sources", "sources", LEFT, lambda rows: rows.select("domain", "source", "docs", "lean", F.col("field").isNull().alias("no_field"))),
    "route_docs_total": _asked("docs", "total", {"term": "Governo", "kind": "word", "week": "2026-08-26"}),
    "route_docs_page": _asked("docs", "page", {"week": "2026-08-26", "limit": "18", "offset": "50"}),
    "route_docs_with": _asked("docs", "page", {"with": B, "day": "2026-08-30", "limit": "100"}, lambda rows: rows.select("doc_id", "uri")),
    "route_timeline": _asked("timeline", "timeline", {"bucket": "day", "term": "governo", "days": "7", "source": "rss,gnews"}),
    "route_week_about": _asked("week", "about", {"source": "rss"}),
    "route_week_terms": _asked("week", "terms", {"kind": "word", "limit": "5", "country": "all"}),
    "route_week_testimony": _asked("week", "testimony", {"testimony": "1", "source": "rss"}),
    "route_rising_terms": _asked("rising", "terms", {"kind": "word,hashtag", "min": "2", "limit": "12"}),
    "route_rising_present": _asked("rising", "present", {"kind": "word,hashtag", "min": "2", "limit": "12"}),
    "route_rising_about": _asked("rising", "about", {"kind": "word,hashtag", "min": "2", "limit": "12"}),
    "route_testimony": _asked("testimony", "testimony", {"days": "7", "source": "rss,gkg", "min": "1"}),
    "route_lenses": _asked("lenses", "terms", {"a": "source:rss", "b": "lean:left", "days": "21", "limit": "12", "kind": "word"}),
    "route_lenses_about": _asked("lenses", "about", {"a": "source:rss", "b": "lean:left"}),
    "route_attention": _asked("attention", "series", {"days": "7"}),
    "route_persistence_terms": _asked("persistence", "terms", {"weeks": "4", "limit": "30"}, lambda rows: rows.withColumn("series", F.array_join("series", ",", "-"))),
    "route_persistence_info": _asked("persistence", "info", {"weeks": "4"}),
    "route_compare": _compared("terms", {"a": A, "b": B, "source": "rss,gnews,gkg", "limit": "20", "bridges": "1"}, lambda rows: rows.withColumn("bridge", F.round("bridge", 9))),
    "route_compare_about": _compared("about", {"a": A, "b": B, "source": "rss,gnews,gkg"}),
    "route_tone": _asked("tone", "cells", {"days": "7", "min": "1"}),
    "route_tone_domains": _asked("tone", "domains", {"days": "7", "min": "1"}),
    "route_agenda": _asked("agenda", "cells", {"days": "7", "source": "rss,gnews", "min": "2"}),
    "route_candidates": _asked("candidates", "names", {"days": "21", "min": "3", "limit": "20"}),
    "route_candidate_samples": _asked("candidates", "samples", {"days": "21", "min": "3", "limit": "20"}, lambda rows: rows.select("name", "rn", "doc_id")),
    "route_comention": _asked("comention", "pairs", {"days": "7", "lean": "left,right,center", "min": "1"}),
}
