"""Every registered query against its SQL, and rules that all plans must keep."""

import pytest

import __spark_entry__ as entry
from conftest import plan_of
from oracle_check import compare, connect
from termloom.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# iterative training has no SQL counterpart
ROWS_ONLY = {"train_svm", "platt_calibrate", "predict_svm", "evaluate_svm"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql_unless_it_trains():
    assert set(QUERIES) - set(entry.oracle_sql()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ROWS_ONLY))
def test_query_matches_sql(spark, duck, name):
    ok, rows, message = compare(
        spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR
    )
    assert ok and rows > 0, message
    assert not message, f"types differ: {message}"


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_training_queries_run(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["cluster_id", "label", "n_docs", "idx", "value"]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ROWS_ONLY))
def test_plan_rules(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert forbidden not in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(QUERIES["token_counts"](spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
