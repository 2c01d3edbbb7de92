"""Suggestions against all pairs, with words and names in many blocks, and what a block costs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import vocab as vo


def grams(text):
    return {f"  {w} "[i : i + 3] for w in re.split(r"[^\w]+", text.lower()) if w for i in range(len(w) + 1)}


def sim(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("WORDS", 16), ("NAMES", 64), ("MAPS", 5), ("_ROWS", 3), ("_PAIRS", 40)):
        monkeypatch.setattr(vo, name, value)


def made(seed):
    r = random.Random(seed)
    make = lambda: "".join(r.choice("aab") for _ in range(r.randint(1, 12))) + r.choice(["", "ing", " b", "-ab", "É"])
    words = sorted({make() for _ in range(50)} | {"ab", "A", "b-a", "", "ba ", "É"})
    terms = sorted({(r.choice(["en", "fr"]), make(), r.randint(1, 4)) for _ in range(260)})
    return words, list({(lang, t): (lang, t, n) for lang, t, n in terms}.values())


def frame(spark, words):
    return spark.createDataFrame([(w,) for w in [*words, None]], "word string")


def test_near_in_blocks(spark, small_blocks):
    words, terms = made(1)
    df = vo.near(frame(spark, words), spark.createDataFrame([(t,) for _, t, _ in terms] + [(None,)], "term string"), 0.3)
    want = {(w, t): sim(w, t) for w in words for _, t, _ in terms if sim(w, t) >= 0.3}
    got = df.collect()
    assert len(got) == len(want) > 100 and {(r["word"], r["term"]): r["sim"] for r in got} == want


def test_term_suggestions_against_all_pairs(spark, small_blocks):
    words, terms = made(2)
    df = vo.term_suggestions(frame(spark, words), spark.createDataFrame([*terms, ("en", None, 9)], "lang string, term string, df long"), 4)
    want = set()
    for w in filter(None, words):
        rows = sorted((-int(t.startswith(w)), -sim(w, t), -n, t, lang) for lang, t, n in terms if t.startswith(w) or sim(w, t) >= 0.3)[:4]
        want |= {(w, t, lang, -starts, -s, i + 1) for i, (starts, s, _, t, lang) in enumerate(rows)}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) > 100 and set(got) == want


def test_title_suggestions_against_all_pairs(spark, small_blocks):
    words, terms = made(3)
    titles = [(lang, f"{t.upper()} {n}") for lang, t, n in terms]
    df = vo.title_suggestions(frame(spark, words), spark.createDataFrame([*titles, *titles[:9], ("en", None), (None, "ab b")], "lang string, title string"), 3)
    want = set()
    for w in filter(None, words):
        for own in ("en", "fr", None):
            rows = sorted((-sim(w, t), t) for lang, t in [*titles, (None, "ab b")] if lang == own and (w.lower() in t.lower() or sim(w, t) >= 0.3))[:3]
            want |= {(w, t, own, int(t.lower().startswith(w)), -s, i + 1) for i, (s, t) in enumerate(rows)}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) > 100 and set(got) == want


def test_closest_against_all_pairs(spark, small_blocks):
    words, terms = made(4)
    one = list({t: (t, n) for _, t, n in terms}.values())
    got = {r["word"]: (r["term"], r["sim"]) for r in vo.closest(frame(spark, words), spark.createDataFrame(one, "term string, df long")).collect()}
    want = {}
    for w in words:
        rows = sorted((-sim(w, t), -n, t) for t, n in one if sim(w, t) >= 0.4)
        if rows:
            want[w] = (rows[0][2], -rows[0][0])
    assert got == want and len(want) > 20


@pytest.mark.parametrize("make", [
    lambda w, t: vo.term_suggestions(w, t), lambda w, t: vo.title_suggestions(w, t.select("lang", F.col("term").alias("title"))),
    lambda w, t: vo.closest(w, t), lambda w, t: vo.suggestions(w, t, t.select("lang", F.col("term").alias("title"))),
])
def test_only_the_best_of_a_block_are_moved(spark, make):
    """All words are alike: nothing that moves or is ranked has a row for each pair, or for each part of a name."""
    terms = spark.range(4000).select(F.lit("en").alias("lang"), F.format_string("aaaaa%05d", F.col("id")).alias("term"), (F.col("id") % 5).alias("df"))
    df = make(spark.range(100).select(F.format_string("aaaaa%05d", F.col("id") * 3).alias("word")), terms)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    most, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
            continue
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < most <= 40_000  # 400,000 pairs
