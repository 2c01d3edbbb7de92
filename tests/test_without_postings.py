"""Queries that need no row for each match of a term and a document: neither postings nor such a join is made for them."""

import os

import pytest

import __spark_entry__ as entry
from quillspark.operators import index as ix
from quillspark.operators import ranking as rk
from quillspark.plans import base, evaluation, ranking

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are absent")
NAMES = [
    "v04_title_suggestions",
    "a01_pool",
    "m01_set_metrics",
    "d11_many_methods",
    "v03_term_suggestions",
    "v05_suggestions",
    "x01_per_query_values",
    "x04_wilcoxon",
    "m02_cutoff_metrics",
    "m09_closed_pool",
    "m16_capped_recall",
    "v02_candidates",
    "v06_closest_term",
    "v07_did_you_mean",
    "x03_paired_t",
    "x10_delta_table",
    "a04_training_pool",
    "m08_system_table",
    "x02_comparison_pairs",
    "m03_average_precision",
    "x08_analysis",
    "m11_graded_only",
    "x06_direction",
    "x11_ranked_variants",
    "m04_jaccard",
    "m05_ndcg",
    "m10_evaluation",
    "x09_variant_tests",
]


@pytest.fixture(scope="module")
def anew():
    """Nothing is written yet, and what makes postings or joins them fails."""

    def refused(*_, **__):
        raise AssertionError("postings are made")

    with pytest.MonkeyPatch.context() as m:
        for module, name in ((ranking, "_deep"), (base, "_made"), (base, "_terms"), (base, "_judged"), (evaluation, "_metrics")):
            m.setattr(module, name, {}, raising=False)
        for module, name in ((rk, "_matches"), (ix.Index, "save")):
            m.setattr(module, name, refused)
        yield


@pytest.mark.parametrize("name", NAMES)
def test_without_postings(spark, anew, name):
    df = entry.queries()[name](spark, FOLDER)
    assert df.count() >= 0


def test_written_once(spark, anew):
    before = evaluation.metrics(spark, FOLDER, ranking.whole_run).inputFiles()
    assert before and evaluation.metrics(spark, FOLDER, ranking.whole_run).inputFiles() == before
    assert base.qrels(spark, FOLDER).inputFiles() == base.qrels(spark, FOLDER).inputFiles()
