import datetime as dt

import pytest
from pyspark.sql import functions as F

from liame.corpus import Corpus, Person
from liame.operators import networks as nw
from liame.operators import outlets as ot
from liame.operators import post as po
from liame.operators import series as sr
from liame.operators import terms as tm
from liame.operators.scope import Scope, in_scope, with_term
from liame.plans import router as rt
from liame.streaming import ingest as ig

DOCS = "doc_id long, source string, uri string, text string, published_at timestamp_ntz, collected_at timestamp_ntz, domain string, country string, tone double, reach_likes int, reach_reposts int, reach_replies int, reach_quotes int"
T = lambda s: dt.datetime.fromisoformat(s)


def doc(i, source="rss", uri=None, text="t", at="2026-08-30T12:00:00", domain="a.br", country="br", tone=None, reposts=None, got=None):
    return (i, source, uri or f"u{i}", text, T(at), T(got or at), domain, country, tone, None, reposts, None, None)


@pytest.fixture(scope="module")
def c(spark):
    docs = spark.createDataFrame([
        doc(1, tone=1.0, reposts=2), doc(2, country=None, tone=None), doc(3, country="pt"), doc(4, source="bluesky", domain="@x", reposts=0),
        doc(5, at="2026-09-03T00:00:00"), doc(6, at="2026-01-01T00:00:00"), doc(7, domain=None),
    ], DOCS)
    mk = spark.createDataFrame
    terms = mk([(1, "word", "ana"), (2, "word", "reforma"), (3, "phrase", "ana lima"), (4, "word", "saude")], "term_id long, kind string, term string")
    doc_terms = mk([(1, 1), (1, 2), (2, 2), (4, 2), (4, 4), (5, 4), (7, 3), (1, 4)], "doc_id long, term_id long")
    doc_persons = mk([(1, "ana"), (2, "ana"), (4, "rui"), (5, "ana"), (7, "ana"), (1, "rui")], "doc_id long, person_id string")
    persons = mk([("ana", "Ana Lima", ["Ana Lima", "Ana"]), ("rui", "Rui", ["Rui Sá"])], "id string, name string, aliases array<string>")
    empty = mk([], "doc_id long, name string")
    return Corpus(docs, doc_persons, doc_terms, terms, persons, empty, mk([], "term string, count int, score double"))


ANA = Person("ana", "Ana Lima", ("Ana Lima", "Ana"))


def test_scope_is_open_to_the_future_and_keeps_unknown_countries(c):
    assert sorted(r[0] for r in in_scope(c.docs, Scope(21)).select("doc_id").collect()) == [1, 2, 4, 5, 7]
    assert sorted(r[0] for r in in_scope(c.docs, Scope(21, country="pt")).select("doc_id").collect()) == [3]


def test_empty_lists_match_nothing(c):
    assert in_scope(c.docs, Scope(21, sources=())).count() == 0
    assert in_scope(c.docs, Scope(21, domains=("z.br",), leans=("left",)), {"a.br": "left"}).count() == 0


def test_own_words_are_no_terms_of_a_person(c):
    rows = {r["term"]: r["count"] for r in tm.graph_nodes(c, ANA, Scope(21), least=1).collect()}
    assert rows == {"reforma": 2, "saude": 2}


def test_reach_is_null_where_none_is_known_and_zero_counts(c):
    rows = {r["term"]: r["reach"] for r in tm.term_counts(c, c.docs).collect()}
    assert rows["ana lima"] is None and rows["reforma"] == 2


def test_pmi_by_hand(c):
    row = tm.graph_nodes(c, ANA, Scope(21), least=1).where("term = 'reforma'").first()
    assert row["pmi"] == pytest.approx(round(__import__("math").log2(2 * 5 / (4 * 3)), 2))


def test_unknown_kind_falls_back_to_any(c):
    assert with_term(c, c.docs, "reforma", ("nada",)).count() == 3 and with_term(c, c.docs, "reforma", ("org",)).count() == 0


def test_links_need_two_documents(c, spark):
    keys = spark.createDataFrame([("word", "reforma"), ("word", "saude")], "kind string, term string")
    assert [tuple(r) for r in tm.links(c, c.docs, keys).collect()] == [("word:reforma", "word:saude", 2)]


def test_timeline_buckets_sum_to_the_documents(c):
    docs = in_scope(c.docs, Scope(21))
    rows = sr.timeline(docs, 21, 7).orderBy("i").collect()
    assert [r["count"] for r in rows] == [5, 0, 0] and sum(r["count"] for r in rows) == docs.count()


def test_exactly_one_bucket_old_is_newest(spark):
    docs = spark.createDataFrame([doc(1, at="2026-08-25T00:00:00"), doc(2, at="2026-08-24T23:59:59")], DOCS)
    assert [r["count"] for r in sr.timeline(docs, 21, 7).orderBy("i").collect()] == [1, 1, 0]


@pytest.mark.parametrize("counts,want", [
    ([None, 3, 8, 4, 5, None], (4, 1)), ([1, None, 2, 2], (2, None)), ([5, 2, None, None], (0, 1)), ([3, 3, 1, 9], (4, 1)), ([None, None, None, None], None),
])
def test_streak_and_half_life(spark, counts, want):
    weeks = [dt.date(2026, 8, 31) - dt.timedelta(7 * (len(counts) - 1 - i)) for i in range(len(counts))]
    rows = [("p", "t", "word", w, n) for w, n in zip(weeks, counts) if n is not None]
    got = sr.persistence(spark.createDataFrame(rows, "person_id string, term string, kind string, week date, count long"), len(counts)).collect()
    assert (tuple(got[0][k] for k in ("streak", "half_life")) if got else None) == want


def test_testimony_levels(c, spark):
    scores = spark.createDataFrame([(1, "ana", 2.0), (2, "ana", None), (5, "ana", 4.0)], "doc_id long, person_id string, score double")
    rows = {(r["level"], r["source"], r["domain"]): (r["score"], r["n"]) for r in ot.testimony(c, scores, ANA, least=2).collect()}
    assert rows == {("overall", None, None): (3.0, 2), ("source", "rss", None): (3.0, 2), ("domain", "rss", "a.br"): (3.0, 2)}


def test_jaccard_ties_go_by_name(spark):
    rows = [(d, "word", t) for d, ts in {"a": "xy", "b": "xy", "c": "xz", "d": "q"}.items() for t in ts]
    near = ot.neighbours(ot.jaccard(spark.createDataFrame(rows, "domain string, kind string, term string")), 1)
    assert {r["domain"]: r["neighbor"] for r in near.collect()} == {"a": "b", "b": "a", "c": "a"}


def test_louvain_splits_two_cliques():
    clique = lambda names: [(a, b, 3.0) for i, a in enumerate(names) for b in names[i + 1 :]]
    found = nw.louvain(["z"], [*clique("abcd"), *clique("efgh"), ("d", "e", 1.0)])
    assert len({found[x] for x in "abcd"}) == 1 and len({found[x] for x in "efgh"}) == 1 and len({found[x] for x in "aez"}) == 3


def test_betweenness_of_a_path_and_a_star():
    assert nw.betweenness([("a", "b"), ("b", "c")]) == {"a": 0.0, "b": 1.0, "c": 0.0}
    assert nw.betweenness([("m", x) for x in "abc"])["m"] == 3.0


def test_bridges_without_paths_are_zero(spark):
    rows = nw.bridges(spark.createDataFrame([("k", "a", "b", 1)], "k string, s string, t string, count long"), ["k"]).collect()
    assert {r["bridge"] for r in rows} == {0.0}


def test_merge_replays_arrivals(spark):
    docs = spark.createDataFrame([
        doc(1, uri="u", text="short", domain=None, country=None, got="2026-08-30T10:00:00"), doc(2, uri="u", text="longer text", domain="b.br", tone=5.0, got="2026-08-30T11:00:00"),
        doc(3, uri="u", text="equal texts", domain="c.br", got="2026-08-30T12:00:00"), doc(4, source="gkg", uri="v", tone=None), doc(5, source="gkg", uri="v", tone=2.0, got="2026-08-30T13:00:00"),
        doc(6, uri="w", text=None, domain=None),
    ], DOCS)
    rows = {r["uri"]: r for r in ig.merged(docs, ["collected_at", "doc_id"]).collect()}
    u = rows["u"]
    assert (u["doc_id"], u["text"], u["domain"], u["tone"], u["arrivals"], u["enriched"]) == (1, "longer text", "b.br", None, 3, True)
    assert rows["v"]["tone"] == 2.0 and rows["v"]["enriched"] and rows["w"]["text"] is None and not rows["w"]["enriched"]


def test_merge_in_two_steps_equals_one(spark):
    docs = spark.createDataFrame([doc(i, source="bluesky", uri="u", text="x" * (i % 3), reposts=(i * 7) % 5, got=f"2026-08-30T1{i}:00:00") for i in range(5)], DOCS)
    order = ["collected_at", "doc_id"]
    first = ig.merged(docs.where("doc_id < 3"), order).withColumn("collected_at", F.lit("2026-08-30T10:00:00").cast("timestamp_ntz"))
    both = ig.merge_into(first, docs.where("doc_id >= 3"), order).select("uri", "doc_id", "text", "reach_reposts")
    assert both.collect() == ig.merged(docs, order).select("uri", "doc_id", "text", "reach_reposts").collect()


def test_layers_and_retention(spark):
    docs = spark.createDataFrame([doc(1, uri="u"), doc(2, uri="u", got="2026-08-31T00:00:00"), doc(3, at="2026-08-11T00:00:00"), doc(4, at="2026-08-10T23:59:59")], DOCS)
    assert {r["doc_id"]: r["layer"] for r in ig.layers(docs, ["collected_at"]).collect()}[2] == 1
    assert sorted(r["doc_id"] for r in ig.retained(docs).collect()) == [1, 2, 3]


def test_views_keep_the_last_valid_row(spark):
    rows = [("p", "2026083000", 5, 1), ("p", "2026083000", 7, 2), ("p", "2026023000", 1, 3), ("p", "x", 1, 4), ("p", "2026082900", -1, 5)]
    got = ig.latest_views(spark.createDataFrame(rows, "person_id string, timestamp string, views long, seq int")).collect()
    assert [(str(r["day"]), r["views"]) for r in got] == [("2026-08-30", 7)]


def test_balances(spark):
    rows = spark.createDataFrame([(1.0, 3.0), (None, 2.0), (2.0, None), (0.0, 0.0), (-1.0, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(po.balance(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, -1.0, 0.0, 0.5]


def test_router_routes_only_what_is_built():
    assert rt.precomputable(Scope(21)) and rt.precomputable(Scope(7, sources=("rss",)))
    assert not rt.precomputable(Scope(30)) and not rt.precomputable(Scope(21, country="all")) and not rt.precomputable(Scope(21, sources=("rss", "gkg")))


def test_operators_take_empty_tables(c):
    none = Corpus(**{k: v.limit(0) for k, v in c.__dict__.items()})
    assert tm.graph_nodes(none, ANA, Scope(21)).count() == 0 and ot.comention(none, Scope(21)).count() == 0
    assert [r["count"] for r in sr.timeline(none.docs, 21, 7).collect()] == [0, 0, 0]
