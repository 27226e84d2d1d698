"""Every operation takes empty tables with the right columns."""

import pytest

from liame.llm import leaks, lines, private, truncation, visual


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([], "doc_id long, source string, domain string, text string, count long, key string")


def test_lines(docs):
    assert lines.repeated_lines(docs).count() == 0 and lines.without_lines(docs, lines.repeated_lines(docs)).count() == 0


def test_visual(docs):
    members, classes = visual.same_looking(docs)
    assert members.count() == 0 and classes.count() == 0


def test_truncation(docs):
    assert truncation.truncated(docs).count() == 0


def test_leaks(spark, docs):
    assert leaks.leaked(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert leaks.leaked(docs, spark.createDataFrame([(1, "a " * 30)], "item_id long, text string")).count() == 0


def test_private(spark, docs):
    persons = spark.createDataFrame([], "name string, aliases array<string>")
    assert private.personal_data(docs, persons).count() == 0 and private.redacted(docs, persons).count() == 0
