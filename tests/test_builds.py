"""Builds cover every window, source and person."""

import os

import pytest

from liame import catalogue
from liame.corpus import corpus
from liame.operators import outlets as ot
from liame.operators.scope import Scope
from liame.plans import build as bd
from tests.tables import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_communities_of_every_window_source_and_person(spark):
    rows = catalogue.QUERIES["term_communities"](spark, DATA).cache()
    c = corpus(spark, DATA)
    for days in (7, 21):
        want = bd.person_terms(c, days).selectExpr("days", "source", "person_id", "concat(kind, ':', term) as node")
        got = rows.where(f"days = {days}").select("days", "source", "person_id", "node")
        assert want.count() == got.count() and want.exceptAll(got).count() == 0
    assert rows.where("source <> 'all'").count() > 0


def test_outlets_of_every_person_in_both_windows(spark):
    c = corpus(spark, DATA)
    built = catalogue.QUERIES["build_outlet_terms"](spark, DATA).cache()
    near = catalogue.QUERIES["build_outlet_neighbors"](spark, DATA).cache()
    fields = catalogue.QUERIES["build_outlet_fields"](spark, DATA)
    assert {r["days"] for r in built.select("days").distinct().collect()} == {7, 21} and built.select("person_id").distinct().count() > 1
    assert fields.count() == built.select("days", "person_id", "domain").distinct().count()
    for days, who in ((21, catalogue.A), (7, catalogue.A), (21, catalogue.B)):
        one = ot.outlet_terms(c, c.person(who), Scope(days))
        own = lambda df: df.where(f"days = {days} and person_id = '{who}'").drop("days", "person_id")
        assert sorted(map(tuple, own(built).collect())) == sorted(map(tuple, one.collect()))
        assert sorted(map(tuple, own(near).collect())) == sorted(map(tuple, ot.neighbours(ot.jaccard(one)).collect()))
