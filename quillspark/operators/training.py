"""Training pairs for encoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import anchor, clean


def query_pairs(qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(anchor, passage, lang) of judged queries and documents from grade 1 on that have text."""
    rows = qrels.filter("grade >= 1").join(queries.select("query_id", F.col("text").alias("q")), "query_id").join(docs.select("doc_id", "lang", F.col("text").alias("t")).filter(clean(F.col("text")) != ""), "doc_id")
    return rows.select(anchor(F.col("q"), "query", F.col("lang")).alias("anchor"), anchor(F.col("t"), "passage", F.col("lang")).alias("passage"), "lang")


def concept_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(anchor, passage, lang) of verified concepts in each language with a passage."""
    long = pairs.filter("status = 'verified'").select("doc_id", F.explode(F.array(F.struct(F.lit("en").alias("lang"), F.col("concept_en").alias("q")), F.struct(F.lit("ar").alias("lang"), F.col("concept_ar").alias("q")))).alias("c")).select("doc_id", "c.*")
    rows = long.filter("q is not null and q <> ''").join(docs.select("doc_id", F.col("text").alias("t")).filter(clean(F.col("text")) != ""), "doc_id")
    return rows.select(anchor(F.col("q"), "query", F.col("lang")).alias("anchor"), anchor(F.col("t"), "passage", F.col("lang")).alias("passage"), "lang")


def split(pairs: DataFrame, key: str, share: float = 0.15, seed: str = "split") -> DataFrame:
    """Adds ``part``: the first 15 percent by a hash of the key, at least one row, validate.

    The counts of the hashes' first four digits, at most 65,536 rows, tell which
    of these the cut falls into; only that part is sorted.
    """
    h = pairs.withColumn("h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    head = F.substring("h", 1, 4)
    sizes = sorted((row["head"] or "", row["n"]) for row in h.groupBy(head.alias("head")).agg(F.count("*").alias("n")).collect())
    left, edge = max(1, int(sum(n for _, n in sizes) * share)), ""
    for own, n in sizes:
        if left <= n:
            edge = h.filter(F.coalesce(head, F.lit("")) == own).select("h").orderBy("h").offset(left - 1).limit(1).first()["h"] or ""
            break
        left -= n
    return h.withColumn("part", F.when(F.coalesce("h", F.lit("")) <= edge, "validation").otherwise("train")).drop("h")


def leaks(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Training queries whose normalised text is also an evaluation query; must be empty."""
    key = F.lower(clean(F.col("text")))
    return train.withColumn("k", key).join(evaluation.select(key.alias("k")).distinct(), "k", "left_semi").drop("k")
