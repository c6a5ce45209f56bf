"""Every registered query against its SQL in another engine."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import connect, duck_rows, spark_rows

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


# operators that pair all rows, and those that leave the JVM; the queries named here run numpy in their tasks
ALL_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")
PYTHON = ("EvalPython", "InPandas", "MapInArrow", "InArrow")
WITH_PYTHON = re.compile(r"(op(1|2|3|4|5|6|7|9|12|13)_.*|pipeline)$")


def unwanted(name, plan):
    return [operator for operator in ALL_PAIRS + (() if WITH_PYTHON.match(name) else PYTHON) if operator in plan]


def checked_plan(name, df):
    assert not unwanted(name, df._jdf.queryExecution().executedPlan().toString())
    return df


def test_the_guard_sees_python(spark):
    through = spark.range(3).mapInArrow(lambda batches: batches, "id long")
    plan = through._jdf.queryExecution().executedPlan().toString()
    assert unwanted("hourly_grid_summary", plan) and not unwanted("op2_line_rules", plan)
    pairs = spark.range(3).crossJoin(spark.range(3).hint("merge"))
    assert unwanted("op2_line_rules", pairs._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, duck, name):
    assert spark_rows(checked_plan(name, QUERIES[name](spark, sf_dir))) == duck_rows(duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, sf_dir, name):
    assert checked_plan(name, QUERIES[name](spark, sf_dir)).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_flagship(spark):
    busiest = entry.entry(spark)
    assert busiest.columns == ["grid_id", "total_activity"]
    assert busiest.count() > 0
