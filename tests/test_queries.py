from __future__ import annotations

import pytest

from ledgerloom.plans import all_oracles, all_queries

from .checks import connection, same_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_matches_its_sql(spark, sf_dir, con, name):
    same_rows(all_queries()[name](spark, sf_dir), con, all_oracles()[name])


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert all_queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["settlement_id", "evidence_id", "tx_id", "status", "tier"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
