"""Every query that has SQL gives the same rows as DuckDB; every other one runs."""

import pytest
from conftest import SF, rows

from veilstat.plans import catalog, oracles


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(oracles.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracles.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
