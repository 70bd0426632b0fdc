"""Every registered query against its reference SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
#: Queries of the optional package are held against brute force in tests/llm.
OPTIONAL = ("op", "pipeline")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith(OPTIONAL)])
def test_matches_reference_sql(spark, con, name):
    verdict, detail = compare(spark, con, FOLDER, name)
    assert verdict == "ok", detail


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
