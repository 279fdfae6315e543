"""Every registered query of the library with SQL gives the SQL's rows."""

import pytest

from quarry.plans import chat, corpus, log, state
from tests.compare import database, differences

FOLDER = "/root/testdata/sf0.01"
QUERIES, SQL = corpus.QUERIES | log.QUERIES | chat.QUERIES | state.QUERIES, corpus.SQL | log.SQL | chat.SQL | state.SQL


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, FOLDER, QUERIES[name], SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
