"""Every registered query against DuckDB, and every key covered on both sides."""

import re

import pytest

import __spark_entry__ as entry
from testbed import compare

# the training-data operators have tests of their own
NAMES = [name for name in entry.queries() if not re.match("op[0-9]+_|pipeline$", name)]


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def db(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, folder, name):
    equal, note = compare.compare(spark, db, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert equal, note
