"""Registered queries against their SQL on DuckDB, on the smallest tables.

All of them; PLACEMETRICS_SOME_QUERIES=1 runs every seventh.  An empty answer is a failure.
"""

import os

import pytest

from compare import connect, differences
from placemetrics.queries.catalogue import QUERIES, SQL

FOLDER = "/root/testdata/sf0.01"
NAMES = list(QUERIES)
if os.environ.get("PLACEMETRICS_SOME_QUERIES"):
    NAMES = NAMES[::7]


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, database, name):
    assert not differences(QUERIES[name](spark, FOLDER), database.sql(SQL[name]))
