"""Every registered query against its brute-force SQL over the whole tables."""

import pytest

from checks import oracle, registry
from checks.compare import difference
from checks.compare import oracle as run_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert difference(got, run_sql(SF, oracle.SQL[name])) is None


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(oracle.SQL)
