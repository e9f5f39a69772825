import pytest

from tallyspark.llm.queries import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", name, QUERIES[name], ORACLES[name]) == ""
