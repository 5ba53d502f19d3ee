"""Every registered query against its SQL on the smallest scale."""
import os

import pytest

import workload
from compare import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(workload.ORACLE))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF, workload.QUERIES[name], workload.ORACLE[name]) is None


def test_every_oracle_has_a_query():
    assert set(workload.ORACLE) <= set(workload.QUERIES)
