import os

import pytest

from noteflow.plans import registry
from tests.oracle import SF, compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    compare(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns) and any(v is not None for r in rows for v in r)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
