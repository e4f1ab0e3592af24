"""Every query against its SQL at the smallest scale."""

import os
import sys

import pytest
from helpers import SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import connect, differences  # noqa: E402

from tabscope.queries import QUERIES, SQL  # noqa: E402

# Each runs a whole profile, clean and analysis; covered by test_reports.
SLOW = {"insights", "evidence_index", "evidence_lookup", "dataset_summary", "report_tables", "analysis_bundle"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        problem, _ = differences(df, con, SQL[name])
        assert problem is None, problem
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
