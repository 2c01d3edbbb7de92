"""Trigram matching against all pairs."""

import random
import re

import pytest

from quillspark.operators import vocab as vo


def grams(text):
    return {f"  {w} "[i : i + 3] for w in re.split(r"[^\w]+", text.lower()) if w for i in range(len(w) + 1)}


@pytest.mark.parametrize("threshold", [0.3, 0.4, 0.5, 1.0])
def test_near_equals_all_pairs(spark, threshold):
    r = random.Random(7)
    make = lambda: "".join(r.choice("aab") for _ in range(r.randint(1, 14))) + r.choice(["", " aab", "ing"])
    words, terms = sorted({make() for _ in range(120)}) + ["", "  "], sorted({make() for _ in range(300)}) + ["", "-"]
    got = vo.near(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string"), threshold)
    want = {}
    for w in words:
        for t in terms:
            a, b = grams(w), grams(t)
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-12:
                want[w, t] = round(len(a & b) / len(a | b), 9)
    rows = got.collect()
    assert len(rows) == len(want) and {(r["word"], r["term"]): round(r["sim"], 9) for r in rows} == want and want


def test_near_is_dealt_over_all_cores(spark):
    """One trigram in every word: the join still has a task a core, and sizes keep its rows apart."""
    terms = [f"aaa{i:05d}" + "b" * (i % 30) for i in range(2000)]
    df = vo.near(spark.createDataFrame([(t[:-1],) for t in terms[:200]], "word string"), spark.createDataFrame([(t,) for t in terms], "term string"), 0.4)
    assert df.count() > 200
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text and "NestedLoop" not in text and "Cartesian" not in text
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
