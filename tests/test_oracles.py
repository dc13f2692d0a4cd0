"""Every query of the catalog against its SQL; those without SQL must give rows."""

import pytest

from tidemark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, sf_dir, duck, same, name):
    same(catalog.QUERIES[name](spark, sf_dir), duck.execute(catalog.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
