"""Every query of the core against its SQL on the smallest data."""

import pytest
from conftest import DATA, same_rows

from figmill.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name, tmp_path):
    one, two = same_rows(spark, duck, QUERIES[name], SQL[name], tmp_path)
    assert not one[:3] and not two[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["panel_id", "scored_at", "reasons", "passed"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
