import os

import pytest

from citemesh import plans  # noqa: F401
from citemesh.plans.catalog import ORACLES, QUERIES

from .oracle import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    mine, theirs, types, diff = compare(QUERIES[name](spark, SF), ORACLES[name], SF)
    assert mine == theirs and not types and not diff, (mine, theirs, types, diff)


def test_every_query_has_a_frame():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100
