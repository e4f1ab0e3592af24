"""Every operator's query against its SQL at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from compare import connect, differences  # noqa: E402

from tabscope.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, name):
    problem, _ = differences(QUERIES[name](spark, small), connect(small), SQL[name])
    assert problem is None, problem


def test_names():
    assert set(SQL) <= set(QUERIES)
