"""Fixed questions to tables that lack a person they ask about."""

import os
import shutil

import pytest

from liame import catalogue
from tests import tables

pytestmark = pytest.mark.skipif(not os.path.isdir(tables.DATA), reason="no test tables")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The test tables without person B, whose documents stay."""
    import duckdb

    to = tmp_path_factory.mktemp("absent")
    for t in tables.TABLES:
        shutil.copy(f"{tables.DATA}/{t}.parquet", to)
    duckdb.execute(f"copy (select * from '{tables.DATA}/persons.parquet' where id <> '{catalogue.B}') to '{to}/persons.parquet' (format parquet)")
    return str(to)


def like_sql(spark, folder, monkeypatch, name):
    monkeypatch.setattr(tables, "DATA", folder)
    assert tables.differences(spark, name, catalogue.QUERIES, catalogue.ORACLES) == (0, 0)


def test_compare_entities(spark, folder, monkeypatch):
    like_sql(spark, folder, monkeypatch, "compare_entities")
    assert catalogue.QUERIES["compare_entities"](spark, folder).where("a_count is not null and b_count is null and is_name_b is null").count() > 0


def test_route_compare(spark, folder, monkeypatch):
    like_sql(spark, folder, monkeypatch, "route_compare")
    assert catalogue.QUERIES["route_compare"](spark, folder).where("a_count is not null and b_count is null").count() > 0


def test_bridge_candidates(spark, folder, monkeypatch):
    like_sql(spark, folder, monkeypatch, "bridge_candidates")


def test_route_compare_about(spark, folder, monkeypatch):
    like_sql(spark, folder, monkeypatch, "route_compare_about")


def test_ruler_balance(spark, folder, monkeypatch):
    like_sql(spark, folder, monkeypatch, "ruler_balance")


def test_fast_equals_live(spark, folder, monkeypatch):
    like_sql(spark, folder, monkeypatch, "fast_equals_live")
