"""Every registered query runs, and agrees with its SQL, on the smallest tables."""

from pathlib import Path

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    verdict, _, rows = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert verdict == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
