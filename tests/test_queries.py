"""Every registered query against its SQL on the smallest data set."""

import pytest

from check_oracles import compare, connect
from recordflow.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)
