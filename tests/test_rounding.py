import os

import pytest

from noteflow.plans import registry
from tests.oracle import connect

SF = os.environ.get("TEST_ROUNDING_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["path_reranked", "note_quality_scores", "note_noise_flags", "path_scores", "path_node_scores"])
def test_floats_equal_those_of_sql_to_the_last_digit(spark, name):
    df = registry.queries()[name](spark, SF)
    cur = connect(SF).execute(registry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())
