"""Retrieval metrics of a run table against graded judgments.

run: (system, query_id, doc_id, rank); qrels: (query_id, doc_id, grade). A
document is relevant from grade 1 on; nDCG uses all grades with gain 2^g - 1.
Precision at k divides by k, average precision by the number of relevant
documents; a metric without a denominator is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (5, 10)


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _f(p: Column, r: Column, beta: float = 1.0) -> Column:
    return _share((1 + beta * beta) * p * r, beta * beta * p + r)


def _gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def _ideal(qrels: DataFrame, cuts: Sequence[int]) -> DataFrame:
    best = qrels.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    part = _gain(F.col("grade")) / F.log2(F.col("r") + 1.0)
    return best.groupBy("query_id").agg(
        F.count_if(F.col("grade") > 0).alias("n_rel"), F.sum(part).alias("idcg"), *[F.sum(F.when(F.col("r") <= k, part)).alias(f"idcg_{k}") for k in cuts]
    )


def per_query(run: DataFrame, qrels: DataFrame, cuts: Sequence[int] = CUTS, digits: int | None = 6) -> DataFrame:
    """One row for each system and judged query, a column for each metric; unrounded for means if digits is None."""
    hit = run.select("system", "query_id", "doc_id", "rank").join(qrels, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    order = Window.partitionBy("system", "query_id").orderBy("rank")
    hit = hit.withColumn("rel", (F.col("grade") > 0).cast("int")).withColumn("seen", F.sum("rel").over(order))
    part = _gain(F.col("grade")) / F.log2(F.col("rank") + 1.0)
    sums = hit.groupBy("system", "query_id").agg(
        F.count("*").alias("n_ret"), F.sum("rel").alias("hits"), F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("rank"))).alias("ap"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(part).alias("dcg"),
        *[F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"hits_{k}") for k in cuts], *[F.sum(F.when(F.col("rank") <= k, part)).alias(f"dcg_{k}") for k in cuts],
    )
    m = sums.join(_ideal(qrels, cuts), "query_id")
    p, r = _share(F.col("hits"), F.col("n_ret")), _share(F.col("hits"), F.col("n_rel"))
    out = {"precision": p, "recall": r, "f1": _f(p, r), "f2": _f(p, r, 2.0), "ap": _share(F.coalesce("ap", F.lit(0.0)), F.col("n_rel")), "rr": F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "jaccard": _share(F.col("hits"), F.col("n_ret") + F.col("n_rel") - F.col("hits")), "dcg": F.coalesce("dcg", F.lit(0.0)), "ndcg": _share(F.col("dcg"), F.col("idcg"))}
    for k in cuts:
        pk, rk = F.col(f"hits_{k}") / k, _share(F.col(f"hits_{k}"), F.col("n_rel"))
        out |= {f"p_{k}": pk, f"r_{k}": rk, f"f1_{k}": _f(pk, rk), f"jaccard_{k}": _share(F.col(f"hits_{k}"), F.least(F.lit(k), F.col("n_ret")) + F.col("n_rel") - F.col(f"hits_{k}")), f"ndcg_{k}": _share(F.col(f"dcg_{k}"), F.col(f"idcg_{k}")), f"capped_{k}": _share(F.col(f"hits_{k}"), F.least(F.lit(k), F.col("n_rel")))}
    table = m.select("system", "query_id", *[c.alias(name) for name, c in out.items()])
    return table if digits is None else rounded(table, digits)


def rounded(table: DataFrame, digits: int = 6) -> DataFrame:
    return table.select("system", "query_id", *[F.round(c, digits).alias(c) for c in table.columns if c not in ("system", "query_id")])


def long(table: DataFrame) -> DataFrame:
    """(system, query_id, metric, value) of a wide table."""
    names = [c for c in table.columns if c not in ("system", "query_id")]
    return table.unpivot(["system", "query_id"], names, "metric", "value")


def mean(c: str) -> Column:
    """The mean of unrounded values to six digits."""
    return F.round(F.avg(c), 6)


def by_system(table: DataFrame) -> DataFrame:
    """The rows of each system and its mean (query_id MEAN), by one pass of grouping sets."""
    names = [c for c in table.columns if c not in ("system", "query_id")]
    sets = table.groupingSets([[F.col("system"), F.col("query_id")], [F.col("system")]], "system", "query_id")
    out = sets.agg(F.grouping_id().alias("g"), *[mean(c).alias(c) for c in names])
    return out.withColumn("query_id", F.when(F.col("g") > 0, "MEAN").otherwise(F.col("query_id").cast("string"))).drop("g")


def closed_pool(run: DataFrame, judged: DataFrame) -> DataFrame:
    """Only judged or pooled documents (query_id, doc_id), ranked anew by score and old rank."""
    order = Window.partitionBy("system", "query_id").orderBy(F.desc("score"), F.col("rank"))
    return run.join(judged.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").withColumn("rank", F.row_number().over(order)).select("system", "query_id", "doc_id", "rank", "score")


def graded_only(table: DataFrame, qrels: DataFrame) -> DataFrame:
    """Long metrics of judged queries, and their means."""
    own = table.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    return own.groupBy("system", "metric").agg(mean("value").alias("mean"), F.count("*").alias("n"))


def selection_ndcg(scored: DataFrame, k: int = 10) -> DataFrame:
    """Mean nDCG at k with linear gain of (version, query_id, pos, label, score); queries without a positive label are skipped."""
    own = Window.partitionBy("version", "query_id")
    r = scored.withColumns({"r": F.row_number().over(own.orderBy(F.desc("score"), "pos")), "best": F.row_number().over(own.orderBy(F.desc("label"), "pos"))})
    dcg = r.groupBy("version", "query_id").agg(F.sum(F.when(F.col("r") <= k, F.col("label") / F.log2(F.col("r") + 1.0))).alias("d"), F.sum(F.when(F.col("best") <= k, F.col("label") / F.log2(F.col("best") + 1.0))).alias("i"))
    return dcg.filter("i > 0").groupBy("version").agg(F.round(F.avg(F.col("d") / F.col("i")), 6).alias("ndcg"), F.count("*").alias("queries"))


def promoted(scores: DataFrame, current: str, margin: float) -> DataFrame:
    """The best candidate (ties: the newer version) and whether it beats the current one by a margin."""
    best = scores.filter(F.col("version") != current).agg(F.max(F.struct("ndcg", "version")).alias("b"))
    now = scores.filter(F.col("version") == current).agg(F.max("ndcg").alias("current"))
    return best.join(F.broadcast(now)).select(F.col("b.version").alias("version"), F.col("b.ndcg").alias("ndcg"), "current", (F.col("b.ndcg") - F.col("current") >= margin - 1e-12).alias("promote"))


def known_items(docs: DataFrame, least: int = 12, share: float = 1.0, seed: str = "known") -> tuple[DataFrame, DataFrame]:
    """(query_id, text) and (query_id, doc_id, grade): the first half of long texts, and every text that starts with it.

    Texts meet by their first six words, then the start is compared.
    """
    words = F.split("text", r"[ \t\n\r\f]+")
    w = docs.select("doc_id", F.array_join(words, " ").alias("text"), words.alias("w"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0 < share
    q = w.filter((F.size("w") >= least) & drawn).select(F.col("doc_id").alias("query_id"), F.array_join(F.slice("w", F.lit(1), F.floor(F.size("w") / 2).cast("int")), " ").alias("query"), F.array_join(F.slice("w", 1, 6), " ").alias("head"))
    rel = q.join(w.select("doc_id", "text", F.array_join(F.slice("w", 1, 6), " ").alias("head")), "head").filter(F.startswith("text", F.col("query"))).select("query_id", "doc_id", F.lit(1).alias("grade"))
    return q.select("query_id", F.col("query").alias("text")), rel


def title_queries(docs: DataFrame, title: Column) -> DataFrame:
    """(title, doc_id) of documents by cleaned title; blank titles are skipped."""
    return docs.select(title.alias("title"), "doc_id").filter("title <> ''").distinct()
