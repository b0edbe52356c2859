"""Every registered query against its SQL on the smallest tables."""
import os

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    assert oracle.compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name]) == []


def test_every_query_has_sql():
    own = {n for n in entry.queries() if n.startswith("q_")}
    assert own == {n for n in entry.oracle_sql() if n.startswith("q_")}
