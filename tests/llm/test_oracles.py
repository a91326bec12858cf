"""Every query of the subpackage with SQL, compared value by value with that SQL run by another engine."""

import pytest
from compare import connect, difference

from tunekit.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, folder).toArrow()
    assert got.num_rows > 0
    assert difference(got, connect(folder).sql(ORACLES[name]).to_arrow_table()) is None


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
