"""Every registered query against its SQL on a second engine."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, connect
from tierscope.plans import oracle, registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_sql(spark, con, name):
    outcome, _ = compare(spark, con, SF_DIR, name)
    assert outcome == "ok"


def test_every_query_has_sql():
    assert registry.queries().keys() == oracle.oracle_sql().keys()
    assert oracle_sql().keys() <= queries().keys()


def test_entry_returns_rows(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "contract_id"
