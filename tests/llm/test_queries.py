from __future__ import annotations

import pytest

from ledgerloom.llm.queries import oracle_sql, queries

from ..checks import connection, same_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, con, name):
    same_rows(queries()[name](spark, sf_dir), con, oracle_sql()[name])


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op")) == list(range(1, 14))
