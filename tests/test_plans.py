"""Plan shape of every registered query (subqueries included): no cartesian product
or nested-loop join, and no Python evaluation -- every expression stays in the JVM.  The one exception is the query whose
feature is to run the user's own Python per group (U4): it may map Arrow batches, and nothing else of the list."""

import pytest

from bizlens.plans.queries import REGISTRY as QUERIES
from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "FlatMapCoGroupsInPandas",
             "AggregateInPandas", "WindowInPandas", "PythonUDF")
USER_CODE = {"user_groups": {"MapInPandas", "FlatMapGroupsInPandas"}}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_shape(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = [op for op in FORBIDDEN if op in plan and op not in USER_CODE.get(name, ())]
    assert not found, f"{name}: {found}"


def test_plan_check_detects_a_cross_join(spark):
    a = spark.range(3).withColumnRenamed("id", "a")
    b = spark.range(3).withColumnRenamed("id", "b")
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(a.crossJoin(b)._jdf.queryExecution(), "formatted")
    assert any(op in plan for op in FORBIDDEN)
