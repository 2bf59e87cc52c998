"""Every registered query against its SQL oracle on the test tables."""

import os

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == entry.entry(spark).columns and result.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    query = QUERIES[name](spark, FOLDER)
    plan = query._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan, f"{name} plans a {operator}"
    result = query.toArrow()
    if name in ORACLES:
        assert differences(result, connect(FOLDER).sql(ORACLES[name]).to_arrow_table()) == []
    else:
        assert result.num_rows > 0
