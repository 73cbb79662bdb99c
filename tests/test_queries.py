"""Every registered query against its SQL, and against rules for its plan."""

import pytest

import __spark_entry__ as entry
from compare import compare

SQL = entry.oracle_sql()
QUERIES = entry.queries()
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, duck, sf, key):
    plans = []

    def run(spark, sf):
        df = QUERIES[key](spark, sf)
        plans.append(df)
        return df

    ok, note = compare(spark, duck, run, SQL[key], sf)
    assert ok, note
    assert not [f for f in FORBIDDEN if f in plan_of(plans[0])]


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, sf, key):
    df = QUERIES[key](spark, sf)
    assert df.count() > 0
    assert not [f for f in FORBIDDEN if f in plan_of(df)]


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["router"] for r in rows} == {"strongest_global", "strongest_per_dataset", "cheapest_global", "oracle",
                                           "random"}
