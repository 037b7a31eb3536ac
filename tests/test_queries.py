"""Every registered query against its SQL check on the smallest tables."""

import os

import pytest

from cutline import workload
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
CHECKS = workload.checks()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(workload.queries()))
def test_query(spark, con, name):
    fn = workload.queries()[name]
    if name not in CHECKS:
        assert fn(spark, SF).count() > 0
        return
    _, problems = compare(spark, con, fn, CHECKS[name], SF)
    assert not problems, problems
