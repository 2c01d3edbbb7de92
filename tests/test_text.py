"""Text expressions on literal inputs."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(("value", "has"), [(None, False), ("nan", False), ("NONE", False), ("  ", False), (" x\n y ", True)])
def test_has_text(spark, value, has):
    assert one(spark, value, tx.has_text) is has


def test_clean_collapses(spark):
    assert one(spark, " a\t\n b ", tx.clean) == "a b"


def test_fold(spark):
    assert one(spark, "  Pray-er! ", tx.fold) == "pray er"
    assert one(spark, "الصَّلاة", tx.fold) == "الصلاه"


def test_arabic(spark):
    out = one(spark, "الله أكبر!!  English 123", tx.arabic_normal)
    assert out == "الله اكبر"
    assert one(spark, "الـــصلاة", tx.arabic_normal) == one(spark, "الصلاة", tx.arabic_normal)
    assert one(spark, "ٱلصَّلاةُ", tx.reranker_form) == "الصلاة"
    assert one(spark, "صَلَّى  الله", tx.encoder_form) == "صلى الله"


def test_stop_words(spark):
    assert one(spark, "the hadith of prayer", tx.english_words) == ["prayer"]


def test_similarity(spark):
    row = spark.createDataFrame([("prayr", "prayer"), ("صيان", "صيام"), ("الصلا", "صلاه"), ("xylophone", "prayer")], "a string, b string")
    got = [round(r["s"], 3) for r in row.select(tx.similarity(tx.trigrams(F.col("a")), tx.trigrams(F.col("b"))).alias("s")).collect()]
    assert got == [0.444, 0.429, 0.1, 0.0]


@pytest.mark.parametrize(("value", "label"), [("622 -623", "622 -623"), ("5, 6", "5, 6"), ("5.0", "5"), ("nan", ""), (None, "")])
def test_number_label(spark, value, label):
    assert one(spark, value, tx.number_label) == label


@pytest.mark.parametrize(("a", "b", "grade"), [("Sahih", None, "Sahih"), ("sahih", "hasan", "Hasan"), ("Da'if", "weak", "Da'if"), ("sahih", "weak", "Unknown"), ("", "موضوع", "Mawdu"), ("?", "", "Unknown")])
def test_grades(spark, a, b, grade):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(tx.normal_grade(F.col("a"), F.col("b")).alias("g")).first()
    assert row["g"] == grade


def test_arabic_tokens_by_analysis(spark):
    from quillspark.operators import corpus as co

    tokens = [("قَالَ", "stop word without an analysis, marks dropped first"), ("كتاب", "kept by its lemma"), ("في", "preposition"), ("مجهول", "no analysis: stays"), ("و", "too short"), ("إلى", "raw form, letters unified"), ("يقول", "lemma is a stop word"), ("كتاب", "again")]
    docs = spark.createDataFrame([(1, "ar", [t for t, _ in tokens]), (2, "ar", []), (3, "ar", None)], "doc_id long, lang string, tokens array<string>")
    analyses = spark.createDataFrame([("كتاب", "كِتَاب", "noun"), ("كتاب", "وكتاب", "verb"), ("في", "في", "prep"), ("يقول", "قال", "verb"), ("شيء", "شيء", None), (None, "x", "noun")], "token string, lemma string, pos string")
    out = {r["doc_id"]: r["tokens"] for r in co.analysed(docs, analyses).collect()}
    assert out == {1: ["كتاب", "مجهول", "الي", "كتاب"], 2: [], 3: []}
    assert co.analysed(docs.limit(0), analyses).count() == 0
    bare = co.analysed(docs.filter("doc_id = 1"), analyses.limit(0)).first()["tokens"]
    assert bare == ["كتاب", "في", "مجهول", "الي", "يقول", "كتاب"]
