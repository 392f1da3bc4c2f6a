"""Every registered query beside its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import oracle_check

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return oracle_check.duck(ROOT)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    ok, note = oracle_check.compare(spark, con, ROOT, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "answer" in df.columns
