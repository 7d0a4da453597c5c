"""Every query with SQL gives DuckDB's rows."""

import pytest

from dayloom import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, duck, same, name):
    same(plans.queries()[name](spark, SF), duck.sql(plans.oracle_sql()[name]).df())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
