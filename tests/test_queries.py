"""Every query of the core beside its SQL on the smallest tables."""

import os

import pytest

from meterloom.plans import registry
from tools import compare

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(DIR)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DIR)
    got = compare.rows(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == compare.rows(cols, rel.fetchall())


def test_flagship(spark):
    assert registry.flagship(spark, DIR).count() > 0
