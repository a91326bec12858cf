"""Every query with SQL, compared value by value with that SQL run by another engine."""

import pytest
from compare import connect, difference

from tunekit.catalog.all import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    assert got.num_rows > 0
    assert difference(got, con.sql(ORACLES[name]).to_arrow_table()) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_points():
    import __spark_entry__ as e

    assert QUERIES.items() <= e.queries().items()
    assert ORACLES.items() <= e.oracle_sql().items()
    assert e.oracle_sql().keys() <= e.queries().keys()


def test_entry(spark):
    import __spark_entry__ as e

    row = e.entry(spark).collect()[0]
    assert row["test_auc"] > 0.9 and row["train_auc"] > 0.9
