"""File sources and versioned tables."""

import datetime
import json

import pytest

from quillspark.operators import corpus
from quillspark.streaming import logs as streams
from quillspark.sources import files, store


def test_csv_encodings(spark, tmp_path):
    for book, enc, text in (("a", "utf-8-sig", "x,1\nصلاة,2\n"), ("b", "cp1256", "صوم,3\n")):
        (tmp_path / book).mkdir()
        (tmp_path / book / "f.csv").write_bytes(("word,n\n" + text).encode(enc))
    rows = {(r["book"], r["word"], r["n"]) for r in files.corpus_csv(spark, str(tmp_path), ["word", "n"]).collect()}
    assert rows == {("a", "x", "1"), ("a", "صلاة", "2"), ("b", "صوم", "3")}
    with pytest.raises(ValueError, match="missing"):
        files.corpus_csv(spark, str(tmp_path), ["other"])


def test_json(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"q1": "text"}))
    (tmp_path / "j.json").write_text(json.dumps({"q1": {"grades": {"7": 2}}}))
    (tmp_path / "p.json").write_text(json.dumps([{"query": "q", "text": "t", "label": 1.0}, {"query": "q"}]))
    assert [tuple(r) for r in files.queries_json(spark, str(tmp_path / "q.json")).collect()] == [("q1", "text")]
    assert [tuple(r) for r in files.qrels_json(spark, str(tmp_path / "j.json")).collect()] == [("q1", 7, 2)]
    assert files.pairs_json(spark, str(tmp_path / "p.json")).count() == 1


def test_renamed(spark):
    df = spark.createDataFrame([("old", None), ("o", "new")], "a string, b string")
    assert [r["b"] for r in files.renamed(df, {"a": "b"}).collect()] == ["old", "new"]


def test_replace_keeps_the_live_version(spark, tmp_path):
    root = str(tmp_path / "t")
    store.replace(spark.range(5), root)
    with pytest.raises(ValueError, match="at least"):
        store.replace(spark.range(2), root, least=4)
    assert store.live(spark, root).count() == 5


def test_numbers_are_dense_over_many_partitions(spark, tmp_path):
    rows = spark.range(400_000).selectExpr("id", "cast(xxhash64(id) as string) AS name").repartition(11)
    out = corpus.renumbered(rows, ["name", "id"], "number", str(tmp_path / "rows"))
    assert out.agg({"number": "max"}).first()[0] == 400_000 and out.select("number").distinct().count() == 400_000
    later = out.selectExpr("number", "name", "lag(name) OVER (PARTITION BY number % 1 ORDER BY number) AS before")
    assert later.filter("before > name").count() == 0


def test_upsert_stream_restarts_without_new_rows(spark, tmp_path):
    schema = "event_id long, key long, label int, event_time timestamp"
    write = lambda rows, mode: spark.createDataFrame(rows, schema).write.mode(mode).parquet(str(tmp_path / "in"))
    start = lambda: {r["key"]: r["label"] for r in streams.upsert(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["key"], "label", str(tmp_path / "state"), str(tmp_path / "c")).collect()}
    at = datetime.datetime(2024, 1, 1)
    write([(1, 7, 0, at), (2, 7, 2, at), (3, 8, 1, at)], "overwrite")
    assert start() == {7: 2, 8: 1}
    assert start() == {7: 2, 8: 1}
    write([(4, 8, 2, at)], "append")
    assert start() == {7: 2, 8: 2}
