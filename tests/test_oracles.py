import pytest

from tallyspark.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    assert compare(spark, SF, name, QUERIES[name], ORACLES[name]) == ""
