"""Every registered query against its SQL, and those without SQL for rows."""

import pytest
from oracle import connect, differences

from shardloom.plans import catalog


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf_dir, connection, name):
    assert differences(catalog.QUERIES[name](spark, sf_dir), connection, catalog.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["shard", "n_rows", "n_bytes", "first_pos", "last_pos"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
