"""Every query of the relational engine against its SQL, or for its rows where there is none."""

import pytest
from compare import SF, same

from tessera.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    if name in catalog.ORACLES:
        same(spark, catalog.QUERIES[name], catalog.ORACLES[name])
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
