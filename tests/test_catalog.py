"""Every catalogue query against its SQL at the smallest scale."""

import os

import pytest

from arborlake.plans.catalog import ORACLE, QUERIES
from tests.crosscheck import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    if name in ORACLE:
        assert difference(spark, connection, name, QUERIES[name], ORACLE[name], SF_DIR) is None
    else:
        assert QUERIES[name](spark, SF_DIR).count() > 0


def test_all_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
