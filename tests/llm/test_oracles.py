import os

import pytest

from tailframe.llm.queries import ORACLES, QUERIES

from ..oracles import DATA, connect, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_its_sql(spark, name):
    assert differences(spark, connect(), QUERIES[name], ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
