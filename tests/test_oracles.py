"""Every query that has SQL gives the rows that the other engine gives."""

from __future__ import annotations

import pytest
from compare import connect, difference

from folioforge.plans.queries import GROUPED, QUERIES, oracles

DATA = "/root/testdata/sf0.001"
SQL = oracles()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_agree(spark, con, name):
    assert difference(QUERIES[name](spark, DATA), con, SQL[name]) == ""


@pytest.mark.parametrize("name", [f.__name__ for f in GROUPED])
def test_grouped_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and sum(r.n for r in rows) == sum(r.mentions for r in QUERIES["lif10_mention_manifest"](spark, DATA).collect())
