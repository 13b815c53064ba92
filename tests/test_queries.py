"""Every registered query against its SQL on the small tables."""

import os

import pytest

from tests.oracle import differences
from weirflow import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    sql = queries.oracle_sql().get(name)
    assert sql, "every query has SQL"
    assert differences(spark, name, queries.queries()[name], sql, SF) is None


def test_filters_reach_the_scan(spark):
    plan = queries.queries()["q1_orders_by_customer"](spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan.split("ReadSchema")[1][:200]


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
