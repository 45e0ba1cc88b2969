"""The operators' queries against their SQL, and what the entry registers."""

import pytest

import __spark_entry__ as entry
from opsmeter.llm.sql import SQL
from testbed import compare


def test_all_operators_are_registered():
    numbers = [name.split("_")[0] for name in entry.queries() if name.startswith("op")]
    assert sorted(numbers) == sorted(f"op{n}" for n in range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", SQL)
def test_operator_equals_sql(spark, folder, name):
    folder = "/root/testdata/sf0.01" if name.startswith("op7") else folder
    db = compare.connect(folder)
    equal, note = compare.compare(spark, db, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert equal, note
