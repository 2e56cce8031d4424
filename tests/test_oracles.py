"""Every registered query against its SQL twin, or for rows where none is given."""

import pytest

from factloom.plans import ORACLES, QUERIES
from tests.check import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
