"""Every registered query against its SQL check on the smallest tables."""

import pytest

from asklens import plans
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
plans.load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, plans.QUERIES[name], plans.CHECKS.get(name), SF)
    assert ok, message
