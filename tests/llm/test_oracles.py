import os

import pytest

from liame.llm import catalogue
from tests.tables import DATA, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, name, catalogue.QUERIES, catalogue.SQL) == (0, 0)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() >= 0
