"""Every core query with SQL gives the rows of its SQL; the others run and give rows."""

import pytest

from pointloom.plans import core_queries, reference_queries, survey_queries
from tests.conftest import same_rows

QUERIES = {**reference_queries.QUERIES, **survey_queries.QUERIES, **core_queries.QUERIES}
SQL = {**reference_queries.ORACLES, **survey_queries.ORACLES, **core_queries.ORACLES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    same_rows(QUERIES[name](spark, sf), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_no_nested_loops(spark, sf):
    """Joins of the hot paths plan as hash or merge joins."""
    for name in ("radius_neighbors", "mutual_reversals", "latest_image", "lagged_correlation"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_scan_is_pruned(spark, sf):
    plan = reference_queries.box_crop(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "recv_ts" not in plan.split("ReadSchema")[-1]
