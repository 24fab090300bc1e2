import pytest

from tessera.plans.registry import ORACLE_SQL, QUERIES

from .compare import assert_same, database


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, db, sf, name):
    assert_same(spark, db, sf, QUERIES[name], ORACLE_SQL[name])


def test_no_nested_loops_or_python_rows(spark, sf):
    for name in ("radius_counts", "capture", "points_in_zones", "box_overlaps", "zonal_bands", "weighted_median"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name
