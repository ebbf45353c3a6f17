"""Every registered query against its SQL, and the plans of the large ones."""

import os
import re

import pytest

import __spark_entry__ as entry
from kith.plans import ORACLES, QUERIES
from tests.check_oracles import compare, views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name)) is None


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLES) == {"knn_graph_topk"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "row_as_text"]


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["knn_cosine_topk", "lookalike_audience", "audience_score", "eval_confusion_matrix",
                                  "rerank_top_m", "overlap_topk_keyed", "knn_cosine_topk_partitioned"])
def test_no_pair_product_in_plans(spark, name):
    assert not re.search("CartesianProduct|NestedLoop", plan(spark, name))


def test_scans_read_what_they_need(spark):
    text = plan(spark, "filter_eq")
    assert "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_acctbal:double>" in plan(spark, "lookalike_audience")
