"""Rankers on a tiny corpus, by hand-computed values and by properties."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import dense as de
from quillspark.operators import index as ix
from quillspark.operators import ranking as rk

TEXTS = {1: "prayer pillar faith", 2: "fasting shield", 3: "prayer fasting bring reward"} | {i: "x y z" for i in range(100, 110)}


@pytest.fixture(scope="module")
def whole(spark):
    tokens = spark.createDataFrame([(i, "en", t.split()) for i, t in TEXTS.items()], "doc_id long, lang string, tokens array<string>")
    return ix.build(tokens), tokens


def terms(spark, text, query_id="q"):
    q = spark.createDataFrame([(query_id, "en", text.split())], "query_id string, lang string, w array<string>")
    return rk.query_terms(q, F.col("w"))


def got(df):
    return [(r["doc_id"], round(r["score"], 6)) for r in rk.top(df).orderBy("rank").collect()]


def test_bm25(spark, whole):
    assert got(rk.bm25(terms(spark, "prayer"), whole[0])) == [(1, 1.526056), (3, 1.34293)]


def test_tfidf_and_overlap(spark, whole):
    assert got(rk.tfidf(terms(spark, "prayer"), whole[0])) == [(1, 1.871802), (3, 1.871802)]
    assert got(rk.term_overlap(terms(spark, "prayer fasting"), whole[0])) == [(3, 2.0), (1, 1.0), (2, 1.0)]


def test_unknown_and_empty(spark, whole):
    assert got(rk.bm25(terms(spark, "unknown"), whole[0])) == []
    assert got(rk.bm25(terms(spark, ""), whole[0])) == []


def test_common_terms_score_negative(spark, whole):
    assert all(s < 0 for _, s in got(rk.bm25(terms(spark, "x"), whole[0])))


def test_filter_is_the_full_ranking_cut(spark, whole):
    allowed = spark.createDataFrame([(2,), (3,)], "doc_id long")
    for f in (rk.bm25, rk.tfidf, rk.term_overlap, rk.hybrid):
        full = got(f(terms(spark, "prayer fasting"), whole[0]))
        assert got(f(terms(spark, "prayer fasting"), whole[0], allowed)) == [x for x in full if x[0] in (2, 3)]


def test_feedback_adds_terms(spark, whole):
    index, tokens = whole
    t = terms(spark, "prayer prayer")
    out = {r["term"]: round(r["weight"], 6) for r in rk.expansion(t, rk.top(rk.bm25(t, index), 5), tokens, index).collect()}
    assert out["prayer"] == 1.0 and len(out) == 4
    assert out["pillar"] == out["faith"] == 0.5  # the first of equal scores in the order of the feedback texts


def test_fusion(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id long, rank int")
    b = spark.createDataFrame([("q", 1, 1), ("q", 3, 2)], "query_id string, doc_id long, rank int")
    out = [(r["doc_id"], r["score"]) for r in rk.fused(a, b).orderBy("rank").collect()]
    assert [d for d, _ in out] == [1, 2, 3] and math.isclose(out[0][1], 2 / 61) and math.isclose(out[1][1], 1 / 62)


def test_refresh_equals_rebuild(spark, whole):
    index, tokens = whole
    changed = spark.createDataFrame([(2, "en", ["prayer", "new"])], "doc_id long, lang string, tokens array<string>")
    removed = spark.createDataFrame([(3,)], "doc_id long")
    new = ix.refresh(index, changed, removed)
    again = ix.build(tokens.filter("doc_id not in (2, 3)").unionByName(changed))
    for name in ("postings", "terms", "lengths", "stats"):
        assert sorted(map(tuple, getattr(new, name).select(*sorted(getattr(new, name).columns)).collect())) == sorted(map(tuple, getattr(again, name).select(*sorted(getattr(new, name).columns)).collect()))


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0])], "doc_id long, e array<double>").select("doc_id", de.unit(F.col("e"), 2).alias("vector"))
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, e array<double>").select("query_id", de.unit(F.col("e"), 2).alias("vector"))
    assert got(de.cosine_scores(q, v)) == [(1, 1.0), (3, 0.707107), (2, 0.0)]


def test_empty_documents_are_refused(spark):
    tokens = spark.createDataFrame([(7, "en", [])], "doc_id long, lang string, tokens array<string>")
    with pytest.raises(ValueError, match="7"):
        ix.refuse_empty(tokens)


def test_cosine_scores_of_many_blocks_of_queries(spark):
    q = spark.range(7).selectExpr("id AS query_id", "array(cast(id AS double), 1d) AS vector")
    v = spark.range(9).selectExpr("id AS doc_id", "array(1d, cast(id AS double)) AS vector")
    rows = de.cosine_scores(q, v, None, 3).collect()
    assert sorted((r["query_id"], r["doc_id"], r["score"]) for r in rows) == [(a, b, float(a + b)) for a in range(7) for b in range(9)]


def test_methods_keep_to_their_languages(spark):
    df = spark.createDataFrame([(1, 5, 1, 0.5), (2, 6, 1, 0.4)], "query_id long, doc_id long, rank int, score double")
    langs = spark.createDataFrame([(1, "en"), (2, "ar")], "query_id long, lang string")
    out = rk.together({"all": df, "some": df}, {"some": ["ar"]}, langs)
    assert sorted((r["system"], r["query_id"]) for r in out.collect()) == [("all", 1), ("all", 2), ("some", 2)]


def test_hints_only_without_results(spark):
    from quillspark.operators import vocab as vo

    terms = spark.createDataFrame([("en", "prayer", 3), ("en", "fasting", 2)], "lang string, term string, df long")
    queries = spark.createDataFrame([(1, "prayr"), (2, "fastin prayer")], "query_id long, text string")
    found = spark.createDataFrame([(2,)], "query_id long")
    assert [tuple(r) for r in vo.did_you_mean(queries, terms, found=found).collect()] == [(1, "prayer")]
    assert {tuple(r) for r in vo.did_you_mean(queries, terms).collect()} == {(1, "prayer"), (2, "fasting prayer")}


def corpus(spark, n=300, seed=0):
    import random

    r = random.Random(seed)
    rows = [(i, "en", [f"w{int(r.expovariate(0.02))}" for _ in range(r.randint(3, 40))]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, lang string, tokens array<string>")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_pruned_by_the_queries_terms(spark):
    from quillspark.sources.store import workspace

    saved = ix.build(corpus(spark)).save(workspace(spark))
    asked = terms(spark, "w1 w2")
    scores = rk.bm25(asked, saved)
    text = plan(scores)
    assert "dynamicpruning" in text.lower() and "lengths" not in text and "/lengths" not in text
    assert got(scores) == got(rk.bm25(asked, ix.build(corpus(spark))))
    scores.collect()
    read, whole = rows_read(scores), saved.postings.count()
    parts = {r[0] for r in asked.select(ix.part_of(F.col("term"))).collect()}
    assert read["postings"] == saved.postings.filter(F.col("part").isin(parts)).count() < whole / 4
    assert read["terms"] < saved.terms.count() / 4


def rows_read(df):
    """Rows that the scans of a table's folder gave, by the folder's name."""
    out, todo = {}, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            name = node.relation().location().rootPaths().head().getName()
            out[name] = out.get(name, 0) + node.metrics().apply("numOutputRows").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def tables(index):
    rows = lambda df, *cs: sorted(tuple(r) for r in df.select(*cs).collect())
    return [rows(index.postings, "lang", "term", "doc_id", "tf", "len"), rows(index.terms, "lang", "term", "df"), rows(index.lengths, "lang", "doc_id", "len"), [(x, n, round(a, 9)) for x, n, a in rows(index.stats, "lang", "n_docs", "avg_len")]]


def test_refreshes_equal_a_full_build(spark):
    from quillspark.sources.store import workspace

    live = ix.Segments(spark, workspace(spark), parts=4)
    docs = {r["doc_id"]: tuple(r) for r in corpus(spark, 60).collect()}
    schema = corpus(spark, 1).schema
    live.create(spark.createDataFrame(list(docs.values()), schema))
    steps = [({1: ["a", "b", "a"], 500: ["new"]}, [2, 3]), ({2: ["back"], 1: ["a"]}, [500]), ({}, [1]), ({900: ["w1", "zz"]}, [12345])]
    for changed, removed in steps:
        before = live.live()
        new = {i: (i, "en", t) for i, t in changed.items()}
        docs = {k: v for k, v in docs.items() if k not in removed} | new
        live.refresh(spark.createDataFrame(list(new.values()), schema), spark.createDataFrame([(i,) for i in removed], "doc_id long"))
        after = live.live()
        assert after[:-1] == before and after[-1]["rows"] == sum(len(set(t)) for t in changed.values())  # only the changed documents' rows
        assert tables(live.index()) == tables(ix.build(spark.createDataFrame(list(docs.values()), schema)))
    full = tables(live.index())
    live.SHARE, live.MOST = 1e9, 2
    assert live.merge() and len(live.live()) == 2 and tables(live.index()) == full
    assert not live.merge()
    live.SHARE = 0
    assert live.merge() and len(live.live()) == 1 and tables(live.index()) == full


def test_two_refreshes_at_once_do_not_lose_one(spark):
    from quillspark.sources import store

    live = ix.Segments(spark, store.workspace(spark), parts=2)
    live.create(corpus(spark, 5))
    old, base = live.live(), live._version()
    live.refresh(corpus(spark, 1), corpus(spark, 0).select("doc_id"))
    with pytest.raises(store.Conflict):
        live._commit(old, base)


def test_best_match_goes_by_language(spark):
    rows = [(1, "ar", ["x", "y"]), (2, "ar", ["x"]), (3, "en", ["x", "z"]), (4, "fr", ["q", "x"]), (5, "fr", ["q"])] + [(i, x, ["f"]) for i in range(10, 20) for x in ("ar", "en", "fr")]
    index = ix.build(spark.createDataFrame(rows, "doc_id long, lang string, tokens array<string>"))
    asked = spark.createDataFrame([(q, x, t, 1.0) for q, t in (("a", "x"), ("b", "y"), ("c", "q"), ("d", "none")) for x in ("ar", "en", "fr")], "query_id string, lang string, term string, weight double")
    assert {r["query_id"]: r["doc_id"] for r in rk.best_match(asked, index).collect()} == {"a": 3, "b": 1, "c": 5}


def test_nearest_equals_numpy(spark):
    import numpy as np

    r = np.random.default_rng(3)
    v = r.integers(-2, 3, (700, 6)).astype(float)  # many ties
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)]
    q = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(v[:40])] + [("none", None)], "query_id string, vector array<double>")
    d = spark.createDataFrame(rows, "doc_id long, vector array<double>").repartition(5)
    for block in (7, 256):
        out = de.cosine_scores(q, d, block=block, k=9)
        assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
        top = {}
        for row in rk.top(out, 9).collect():
            top.setdefault(row["query_id"], []).append(row["doc_id"])
        scores = np.round(v[:40] @ v.T, 9)
        assert top == {f"q{i}": sorted(range(700), key=lambda j: (-scores[i, j], j))[:9] for i in range(40)}
    assert len(rk.top(de.nearest(q, d, 3)).collect()) == 120
    assert de.nearest(q.limit(0), d, 3).count() == de.nearest(q, d.limit(0), 3).count() == 0
    allowed = spark.createDataFrame([(i,) for i in range(0, 700, 100)], "doc_id long")
    assert {r["doc_id"] for r in de.nearest(q, d, 3, allowed).collect()} <= set(range(0, 700, 100))


def test_vector_upsert_checks_lengths(spark):
    kinds = "doc_id long, vector array<double>"
    old = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], kinds)
    new = spark.createDataFrame([(2, [3.0, 4.0]), (3, [5.0, 6.0]), (3, [5.0, 6.0])], kinds)
    assert {r["doc_id"]: r["vector"] for r in de.upserted(old, new, 2).collect()} == {1: [1.0, 0.0], 2: [3.0, 4.0], 3: [5.0, 6.0]}
    with pytest.raises(ValueError, match="2 components: \\[9\\]"):
        de.upserted(old, spark.createDataFrame([(9, [1.0])], kinds), 2)
    assert de.upserted(old, new.limit(0), 2).count() == 2


def test_only_a_complete_release_is_chosen(spark):
    releases = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "release string, created_at long")
    vectors = spark.createDataFrame([(r, i, [1.0]) for r, ids in (("a", (1, 2)), ("b", (1, 2)), ("c", (1,)), ("d", (1, 2, 3))) for i in ids] + [("c", 2, None)], "release string, doc_id long, vector array<double>")
    report = de.release_report(releases, vectors, spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert {r["release"]: (r["missing"], r["strange"]) for r in report.collect()} == {"a": (0, 0), "b": (0, 0), "c": (1, 0), "d": (0, 1)}
    assert de.chosen_release(report) == "b" and de.chosen_release(report, "a") == "a"
    for wanted in ("c", "nothing"):
        with pytest.raises(ValueError):
            de.chosen_release(report, wanted)
    with pytest.raises(ValueError):
        de.chosen_release(report.filter("not complete"))
