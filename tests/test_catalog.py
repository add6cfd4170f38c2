import oracle
import pytest

from quarry.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, sf, name):
    oracle.compare(spark, con, sf, catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
