"""Answers of routes, stored tables and their upkeep."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liame import catalogue
from liame.operators import networks as nw
from liame.operators import routes as rs
from liame.plans import layout, lineage, maintenance
from liame.plans.layout import served
from tests.tables import DATA

needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
RELATIONS = {
    "people": {"people"}, "graph": {"stats", "nodes", "links", "signature", "outlets"}, "sources": {"sources"}, "docs": {"total", "page", "outlets"}, "timeline": {"timeline"},
    "week": {"about", "terms"}, "rising": {"terms", "present", "about", "outlets"}, "testimony": {"testimony"}, "lenses": {"terms", "about"}, "compare": {"terms", "about"},
    "attention": {"series"}, "persistence": {"terms", "info"}, "tone": {"persons", "domains", "cells"}, "agenda": {"persons", "domains", "cells"}, "candidates": {"names", "samples"}, "comention": {"persons", "pairs"},
}


@needs_tables
@pytest.mark.parametrize("route", sorted(RELATIONS))
def test_every_route_answers_its_defaults(spark, route):
    c, x = served(spark, DATA), catalogue.extras(spark, DATA)
    got = rs.answer(c, route, {"a": catalogue.A, "b": catalogue.B}, x, catalogue.A)
    assert set(got) == RELATIONS[route]
    for rows in got.values():
        rows.collect()


@needs_tables
def test_unknown_names_are_told(spark):
    c = served(spark, DATA)
    for route, who in (("graph", "nobody"), ("nothing", catalogue.A), ("compare", None), ("testimony", catalogue.A)):
        with pytest.raises(LookupError):
            rs.answer(c, route, {}, rs.Extras(), who)


@needs_tables
def test_stored_and_live_answers_agree(spark):
    c, x = served(spark, DATA), catalogue.extras(spark, DATA)
    raw = {"sort": "pmi", "limit": "100", "communities": "1"}
    fast = rs.answer(c, "graph", raw, x, catalogue.B)["nodes"]
    live = rs.answer(c, "graph", raw, rs.Extras(), catalogue.B)["nodes"]
    assert fast.drop("community").exceptAll(live.drop("community")).count() == 0 == live.drop("community").exceptAll(fast.drop("community")).count()
    assert fast.where("community is null").count() == 0 and live.where("community is not null").count() == 0


@needs_tables
def test_warm_answers_are_shared_by_requests_that_parse_alike(spark, tmp_path):
    c, x = served(spark, DATA), catalogue.extras(spark, DATA)
    ask = lambda raw, who: rs.warmed(c, str(tmp_path), "b1", "timeline", "timeline", raw, x, who).count()
    assert ask({}, catalogue.A) == ask({"days": "21", "bucket": "week"}, catalogue.A) and len(list((tmp_path / "b1" / "timeline").iterdir())) == 1
    ask({}, catalogue.B)
    assert len(list((tmp_path / "b1" / "timeline").iterdir())) == 2


def test_export_of_windows(spark, tmp_path):
    from liame.operators import extract as ex
    from liame.sources import feeds

    docs = spark.createDataFrame([(1, "rss", "u", None, "Ana Lima e Rui Costa falaram"), (2, "rss", "v", None, "ninguem")], "doc_id long, source string, uri string, published_at timestamp_ntz, text string")
    persons = spark.createDataFrame([("ana", ["Ana Lima"]), ("rui", ["Rui Costa"])], "id string, aliases array<string>")
    feeds.export(ex.windows_of(ex.mention_rows(docs, persons), docs, persons, 3), str(tmp_path / "out"))
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert len(rows) == 1 and [p["person_id"] for p in rows[0]["persons"]] == ["ana", "rui"] and "Rui" in rows[0]["persons"][1]["text"]


def test_derived_tables_are_written_once_and_anew_for_changed_ones(spark, tmp_path):
    (tmp_path / "t.parquet").write_text("a")
    made = []

    def write(path):
        made.append(path)

    first = layout.once(spark, str(tmp_path), "x", write)
    assert layout.once(spark, str(tmp_path), "x", write) == first and len(made) == 1
    (tmp_path / "t.parquet").write_text("abc")
    assert layout.once(spark, str(tmp_path), "x", write) != first and len(made) == 2


def test_released_lineage_is_gone_and_the_rest_stays(spark):
    a = lineage.cut(spark.range(5))
    b = lineage.cut(a.where("id > 1"))
    place = a._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(place)
    lineage.release(a)
    assert not os.path.isdir(place) and b.count() == 3
    lineage.release(spark.range(3))


def test_upkeep(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, name string")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType())])
    new = maintenance.migrated(rows, schema)
    assert new.schema.simpleString() == "struct<id:bigint,kind:string>" and new.where("kind is null").count() == 3
    one, other, less = (maintenance.result_hash(x).first() for x in (rows.orderBy("id"), rows.orderBy(F.desc("id")), rows.distinct()))
    assert one == other != less and maintenance.result_hash(rows.where("false")).first()["rows"] == 0
    assert "Project" in maintenance.explained(rows.select("id")) or "Scan" in maintenance.explained(rows.select("id"))


def modularity(edges, home):
    total = sum(w for *_, w in edges)
    degree, inside = {}, 0.0
    for a, b, w in edges:
        degree[home[a]] = degree.get(home[a], 0) + w
        degree[home[b]] = degree.get(home[b], 0) + w
        inside += w * (home[a] == home[b])
    return inside / total - sum((d / (2 * total)) ** 2 for d in degree.values())


def test_communities_are_as_modular_as_planted_ones():
    rng = random.Random(2)
    planted = {f"n{i:02d}": i % 4 for i in range(48)}
    names = sorted(planted)
    edges = [(a, b, 1.0 + rng.random()) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < (0.6 if planted[a] == planted[b] else 0.05)]
    found = nw.louvain(names, edges)
    assert modularity(edges, found) >= modularity(edges, planted) - 1e-9 and nw.louvain(names, edges[::-1]) == found
