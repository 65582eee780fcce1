"""Every named query against its SQL text on the smallest given tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    expected = db.execute(ORACLES[name]).df()
    assert len(got) > 0
    assert compare(got, expected) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_ids_without_gaps(spark):
    ids = sorted(r.id for r in entry.entry(spark).select("id").collect())
    assert ids == [f"EF{i:08d}" for i in range(1, len(ids) + 1)]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
