"""Every registered query against its SQL, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as entry
from workload.check import compare, duck
from workload.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

# Queries that keep k rows per key must thin them before the shuffle.
LIMITED = ["retain_sessions", "recent_artifacts", "context_retrieval", "topic_search", "relevant_columns", "knn_exact", "top_values"]


@pytest.fixture(scope="module")
def db():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_rows_equal_sql(spark, db, name):
    ok, note = compare(spark, db, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, note


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_product(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


@pytest.mark.parametrize("name", LIMITED)
def test_rows_per_key_are_thinned_before_the_shuffle(spark, name):
    assert re.search(r"WindowGroupLimit .* Partial", plan(spark, name))


def test_only_needed_columns_are_read_and_fences_reach_the_scan(spark):
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double>" in plan(spark, "ols_trend")
    assert re.search(r"PushedFilters: \[.*LessThan\(value", plan(spark, "iqr_outliers"))


def test_every_query_but_the_python_ones_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"text_chunks_recursive", "memory_search", "answer_multiple"}  # the first two have sister queries with SQL


def test_entry(spark):
    assert entry.entry(spark).count() == 11
