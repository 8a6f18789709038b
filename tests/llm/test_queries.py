"""This subpackage's queries against their SQL."""

import os

import pytest

from linkspark.llm import registry
from tests.compare import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    why, n, m = differences(spark, duck(SF), name, registry.QUERIES[name], registry.SQL[name], SF)
    assert why == "", (n, m)
