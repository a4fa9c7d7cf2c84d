"""Every query of the catalog against its SQL, on the smallest sample tables."""

import pytest
from compare import DATA, connect, differences

from __spark_entry__ import entry
from layerflow.plans.catalog import ORACLES, QUERIES

SQL = ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert name in SQL, "every query has an oracle"
    result = QUERIES[name](spark, DATA)
    plan = result._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
    assert differences(result, con, SQL[name]) == []


def test_entry_gives_rows(spark):
    result = entry(spark)
    assert result.columns == ["c_mktsegment", "period", "revenue", "n_lines"]
    assert result.count() > 100


def test_queries_give_rows(con):
    """An oracle that gives nothing would hide a query that gives nothing."""
    empty = [n for n, sql in SQL.items() if not con.execute(f"SELECT 1 FROM ({sql}) LIMIT 1").fetchall()]
    assert empty == []


def test_a_wrong_result_is_noticed(spark, con):
    wrong = QUERIES["e1_aggregate"](spark, DATA).where("l_returnflag <> 'R'")
    assert differences(wrong, con, SQL["e1_aggregate"])
