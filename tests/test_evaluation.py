"""Metrics, agreement and tests on literal inputs."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import corpus as co
from quillspark.operators import judgments as ju
from quillspark.operators import logs as lo
from quillspark.operators import metrics as me
from quillspark.operators import stats as st
from quillspark.operators import training as tr


def measured(spark, docs, grades):
    run = spark.createDataFrame([("s", "q", d, i + 1) for i, d in enumerate(docs)], "system string, query_id string, doc_id long, rank int")
    qrels = spark.createDataFrame([("q", d, g) for d, g in grades.items()], "query_id string, doc_id long, grade int")
    return me.per_query(run, qrels, (1, 3)).first()


def test_metrics(spark):
    m = measured(spark, [1, 2, 3], {1: 1, 4: 1})
    assert [m["precision"], m["recall"], m["f1"]] == [0.333333, 0.5, 0.4]
    m = measured(spark, [9, 1, 2], {1: 1, 2: 1})
    assert [m["p_1"], m["p_3"]] == [0.0, 0.666667]
    assert measured(spark, [1, 9, 2], {1: 1, 2: 1})["ap"] == round((1 + 2 / 3) / 2, 6)
    assert measured(spark, [9, 8, 1], {1: 1})["rr"] == 0.333333
    assert measured(spark, [1, 2], {2: 1, 3: 1})["jaccard"] == 0.333333
    m = measured(spark, [1, 2, 3], {1: 2, 2: 1, 3: 0})
    assert m["dcg"] == round(3 + 1 / math.log2(3), 6) and m["ndcg"] == 1.0
    assert measured(spark, [1], {1: 0})["ndcg"] == 0.0


def test_linear_gain(spark):
    rows = spark.createDataFrame([("v", "q", i, x, 1.0 - i / 10) for i, x in enumerate([2.0, 0.0, 1.0])], "version string, query_id string, pos int, label double, score double")
    assert me.selection_ndcg(rows).first()["ndcg"] == round(2.5 / (2 + 1 / math.log2(3)), 6)


def labels(spark, *who):
    rows = [(a, "q", d, x) for a, own in enumerate(who) for d, x in enumerate(own)]
    return spark.createDataFrame(rows, "annotator_id int, query_id string, doc_id long, label int")


def test_agreement(spark):
    row = ju.agreement(labels(spark, [0, 1, 2])).first()
    assert row["annotators"] == 1 and row["kappa"] is None
    row = ju.agreement(labels(spark, [0, 1, 2], [0, 1, 2])).first()
    assert row["kappa"] == 1.0 and row["raw"] == 1.0
    row = ju.agreement(labels(spark, [0, 1, 2, 0], [0, 1, 0, 2])).first()
    assert [row["raw"], row["kappa"], row["spearman"]] == [0.5, 0.2, -0.3889]


def test_assignment(spark):
    who = spark.createDataFrame([(i, i) for i in range(1, 6)], "annotator_id int, signed_up int")
    q = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "query_id string")
    out = {}
    for r in ju.dealt(who, q).collect():
        out.setdefault(r["annotator_id"], set()).add(r["query_id"])
    assert out == {1: {"q1", "q2"}, 2: {"q3", "q1"}, 3: {"q2", "q3"}, 4: {"q1", "q2"}, 5: {"q3"}}


def test_p_values():
    assert math.isclose(st.t_p_value(2.0, 11), 0.073388, abs_tol=1e-6)
    assert math.isclose(st.t_p_value(0.0, 5), 1.0)
    assert st.wilcoxon_p_value(0, 6, 0, False) == 0.03125


def test_bootstrap(spark):
    rows = spark.createDataFrame([("s", str(i), "m", v) for i, v in enumerate([0.1, 0.9, 0.3, 0.5, 0.35])], "system string, query_id string, metric string, value double")
    r = st.bootstrap(rows, 2000).first()
    assert math.isclose(r["mean"], 0.43) and 0.15 < r["lower"] < 0.32 and 0.55 < r["upper"] < 0.75


def test_reconstruction(spark):
    rows = spark.createDataFrame([("", "A told B", "prayer is key"), ("A told B prayer is key", "", "prayer is key"), ("unrelated", "isnad", ""), ("a b", "a", "b")], "en_full string, en_isnad string, en_matn string")
    out = [tuple(r)[:3] for r in co.reconstructed(rows).collect()]
    assert out == [("A told B prayer is key", "A told B", "prayer is key"), ("A told B prayer is key", "A told B", "prayer is key"), ("unrelated", "isnad", ""), ("a b", "a", "b")]
    assert {r["part"]: r["n"] for r in co.reconstruction_counts(co.reconstructed(rows)).collect()} == {"full": 1, "isnad": 1, "matn": 0}


def test_two_titles_fail(spark):
    rows = spark.createDataFrame([("b", 1, "x"), ("b", 1, "y")], "book string, chapter_number int, title string")
    with pytest.raises(ValueError, match="several titles"):
        co.dimensions(rows)


def test_bands(spark):
    row = spark.range(1).select(ju.bands(F.lit(0.61)).alias("a"), ju.bands(F.lit(None).cast("double")).alias("b")).first()
    assert tuple(row) == ("Substantial agreement", "N/A")


def test_registered_bootstrap_takes_all_resamples(spark, monkeypatch):
    from quillspark.operators import stats
    from quillspark.plans import QUERIES, evaluation

    values = spark.range(12).selectExpr("'s' AS system", "'ap' AS metric", "id AS query_id", "id * id / 7D AS value")
    monkeypatch.setattr(evaluation, "long", lambda s, d: values)
    assert QUERIES["x05_bootstrap"](spark, "").collect() == stats.bootstrap(values, 10_000).collect()
    assert stats.bootstrap(values, 2_000).collect() != stats.bootstrap(values, 10_000).collect()


def test_split_takes_the_smallest_hashes(spark):
    import hashlib

    for n in (0, 1, 7, 500):
        rows = tr.split(spark.range(n).withColumnRenamed("id", "k"), "k").collect()
        order = sorted(range(n), key=lambda k: hashlib.md5(f"split{k}".encode()).hexdigest())
        assert {r["k"] for r in rows if r["part"] == "validation"} == set(order[: max(1, int(n * 0.15))])
        assert len(rows) == n
    twice = tr.split(spark.createDataFrame([(1,), (1,), (None,)], "k long"), "k").collect()
    assert len(twice) == 3


def test_percentiles_by_nearest_rank(spark):
    times = {"/a": [5.0] * 40 + [5.5, 0.25, 7.0, 900.0], "/b": [3.0], "/c": [None]}
    rows = [(p, t, 200, i) for p, own in times.items() for i, t in enumerate(own)]
    log = spark.createDataFrame(rows, "path string, duration_ms double, status int, at int").withColumn("ts", F.timestamp_seconds("at"))
    found = {r["path"]: r for r in lo.method_summary(log).collect()}
    for path in ("/a", "/b"):
        own = sorted(times[path])
        for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            assert found[path][name] == own[math.ceil(q * len(own)) - 1]
    assert found["/c"]["n"] == 1 and found["/c"]["p50"] is None


def test_missing_runs(spark):
    run = spark.createDataFrame([("a", 1)], "system string, query_id long")
    systems, queries = spark.createDataFrame([("a",), ("b",)], "system string"), spark.createDataFrame([(1,), (2,)], "query_id long")
    assert sorted(map(tuple, ju.missing_runs(run, systems, queries).select("system", "query_id").collect())) == [("a", 2), ("b", 1), ("b", 2)]
    assert ju.missing_runs(run, systems.limit(0), queries).count() == 0


def sequential(names, taken, wanted, each=2, most=3):
    """One annotator after another: fewest seats first, then by name."""
    seats, out = {q: taken.get(q, 0) for q in names}, set()
    for a in range(wanted):
        free = [q for q in sorted(names, key=lambda q: (seats[q], q)) if seats[q] < most][:each]
        for q in free:
            seats[q] += 1
            out.add((a, q))
    return out


def test_seats_on_top_of_any_state_equal_the_sequential_rule(spark):
    import random

    r = random.Random(11)
    for case in range(14):
        names = [f"q{i}" for i in range(r.choice([0, 1, 2, 3, 5, 8, 9]))]
        each, most, wanted = r.choice([1, 2, 2, 3, 4]), r.choice([1, 3, 3, 4]), r.randint(0, 14)
        taken = {q: r.randint(0, most + 1) for q in names if r.random() < 0.7}
        who = spark.createDataFrame([(a, a) for a in range(wanted)], "annotator_id int, signed_up int")
        q = spark.createDataFrame([(n,) for n in names], "query_id string")
        t = spark.createDataFrame([*taken.items(), ("gone", 1)], "query_id string, seats int")
        got = [tuple(x) for x in ju.dealt(who, q, each, most, t).collect()]
        assert len(got) == len(set(got)) and set(got) == sequential(names, taken, wanted, each, most), (case, names, taken, each, most, wanted)


def test_ranks_come_from_counts(spark):
    """Against average ranks of every pair; no task holds more than a cell for each pair of labels."""
    import random

    r = random.Random(2)
    rows = [(k, r.randint(0, 2), r.choice([0, 1, 1, 2])) for k in ("a", "b") for _ in range(400)] + [("c", 1, 1), ("c", 1, 2), ("d", None, 1)]
    pairs = spark.createDataFrame(rows, "k string, x int, y int")

    def mean_ranks(v):
        s = sorted(v)
        return [s.index(x) + (s.count(x) + 1) / 2 for x in v]

    for row in ju.spearman(pairs, ["k"]).collect():
        x, y = zip(*[(a, b) for k, a, b in rows if k == row["k"]])
        rx, ry = mean_ranks(x), mean_ranks(y)
        mx, my = sum(rx) / len(rx), sum(ry) / len(ry)
        cov, vx, vy = (sum((a - b) * (c - d) for a, b, c, d in z) for z in (zip(rx, [mx] * len(rx), ry, [my] * len(ry)), zip(rx, [mx] * len(rx), rx, [mx] * len(rx)), zip(ry, [my] * len(ry), ry, [my] * len(ry))))
        if vx * vy == 0:
            assert row["rho"] is None
        else:
            assert math.isclose(row["rho"], cov / math.sqrt(vx * vy), abs_tol=1e-9)
    assert ju.contingency(pairs, ["k"]).count() <= 9 * 3
    human = spark.createDataFrame([(q, d, (q + d) % 3) for q in range(4) for d in range(50)], "query_id int, doc_id int, grade int")
    model = human.withColumn("grade", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.col("grade")))
    out = {x["query_id"]: x["n"] for x in ju.validation(human, model).collect()}
    assert out == {"0": 50, "1": 50, "2": 50, "3": 50, "ALL": 200}


def test_bootstrap_of_one_value_and_of_none(spark):
    kinds = "system string, query_id string, metric string, value double"
    one = st.bootstrap(spark.createDataFrame([("s", "q", "m", 0.25)], kinds), 50).first()
    assert tuple(one)[2:] == (0.25, 0.25, 0.25, 0.0)
    assert st.bootstrap(spark.createDataFrame([], kinds), 50).count() == 0
