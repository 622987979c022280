"""Every registered SQL-checkable query equals its SQL on the smallest tables; heavy model and stream jobs run elsewhere."""

import pytest
from check import compare

from tests_names import ORACLE_NAMES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE_NAMES)
def test_query_equals_sql(name, spark, con):
    import __spark_entry__ as entry

    problem, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert problem is None, problem


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
