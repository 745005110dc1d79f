"""Every registered query of the core against its SQL."""

import pytest

from facet.queries import ORACLES, QUERIES

from .conftest import TABLES, compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], TABLES)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_are_pruned_and_filters_pushed(spark):
    plan = QUERIES["covering_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThanOrEqual(o_totalprice" in plan
    assert "o_orderpriority" not in plan
    assert "TakeOrderedAndProject" in QUERIES["topk_desc"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
