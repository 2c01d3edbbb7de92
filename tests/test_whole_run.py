"""Queries whose run table holds all nine methods for every query of the benchmark."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.operators import dense as de
from quillspark.plans import base, ranking

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are absent")
VECTORS = {"cosine", "rerank", "rrf"}


def nearest(spark, k):
    """(query_id, doc_id): the k nearest of the queries that the language limit leaves out."""
    q = ranking._item_vectors(spark, FOLDER).filter(F.col("query_id") % 3 == 0)
    near = ranking.rk.top(de.nearest(q, ranking._vectors(spark, FOLDER), k), k).select("query_id", "doc_id")
    assert near.count() > 0
    return near


@pytest.mark.parametrize("name, k", [("a01_pool", 50), ("a04_training_pool", 100)])
def test_pools_hold_the_nearest_of_each_query(spark, name, k):
    assert nearest(spark, k).join(entry.queries()[name](spark, FOLDER), ["query_id", "doc_id"], "left_anti").count() == 0
    assert "query_id % 3" not in entry.oracle_sql()[name]


def test_grades_of_the_nearest_of_each_query(spark):
    near = nearest(spark, 10).join(base.table(spark, FOLDER, "documents"), "doc_id", "left_semi")
    left = near.join(base.qrels(spark, FOLDER), ["query_id", "doc_id"], "left_anti")
    assert left.count() > 0
    assert left.join(entry.queries()["a17_model_grades"](spark, FOLDER), ["query_id", "doc_id"], "left_anti").count() == 0
    assert "query_id % 3" not in entry.oracle_sql()["a17_model_grades"]


def by_system(spark, name):
    """The methods with metrics for queries that the language limit leaves out."""
    return {r[0] for r in entry.queries()[name](spark, FOLDER).filter(F.col("query_id") % 3 == 0).select("system").distinct().collect()}


@pytest.mark.parametrize("name", ["m02_cutoff_metrics", "m03_average_precision", "m04_jaccard", "m05_ndcg", "m06_reciprocal_rank", "m07_per_query_table"])
def test_metrics_of_all_methods_for_each_query(spark, name):
    assert VECTORS <= by_system(spark, name)
    assert "query_id % 3" not in entry.oracle_sql()[name]


@pytest.mark.parametrize("name", ["x02_comparison_pairs", "x03_paired_t", "x04_wilcoxon", "x06_direction"])
def test_all_methods_are_compared(spark, name):
    assert {r[0] for r in entry.queries()[name](spark, FOLDER).select("a").distinct().collect()} == set(ranking.SYSTEMS) - {"bm25"}
    assert "query_id % 3" not in entry.oracle_sql()[name]
