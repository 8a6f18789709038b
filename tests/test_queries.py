"""Registered queries against their SQL on the smallest data, and the layout of the package."""

import os
import re

import pytest

from tests.compare import differences, duck

SF = "/root/testdata/sf0.001"


def names():
    import __spark_entry__ as e

    return sorted(k for m in e.CORE for k in m.SQL)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, con, name):
    import __spark_entry__ as e

    why, n, m = differences(spark, con, name, e.queries()[name], e.oracle_sql()[name], SF)
    assert why == "", (n, m)


def test_only_the_entry_knows_the_subpackage():
    home = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "linkspark")
    for folder, _, files in os.walk(home):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as h:
                    assert not re.search(r"linkspark[.]llm|from [.]+llm", h.read()), f
