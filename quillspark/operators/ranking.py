"""Lexical ranking of a whole table of queries in one job.

Rankers take query terms (query_id, lang, term, weight), an index and maybe a
table of allowed doc_ids, and give (query_id, doc_id, score). ``top`` orders by
the score rounded to 9 digits, then by id, and keeps k. Corpus statistics always
come from the whole index; only matches are restricted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .index import Index, part_of

K1, B = 1.2, 0.75
HYBRID = 0.8
FEEDBACK_DOCS, FEEDBACK_TERMS, ALPHA, BETA = 5, 3, 1.0, 0.5
RRF = 60


def query_terms(queries: DataFrame, words: Column) -> DataFrame:
    """(query_id, lang, term, weight): how often each query names each term."""
    return queries.select("query_id", "lang", F.explode(words).alias("term")).groupBy("query_id", "lang", "term").agg(F.count("*").cast("double").alias("weight"))


def _of_parts(table: DataFrame, terms: DataFrame) -> DataFrame:
    """A table's rows in the partitions of some terms: the list of parts, a number each, prunes the scan while it runs."""
    parts = terms.select("part").filter("part >= 0").distinct()
    return table.join(F.broadcast(parts), "part", "left_semi")


def known_terms(terms: DataFrame, index: Index, few: bool = True) -> DataFrame:
    """Query terms that the index has, with their df and the language's statistics; only their partitions are read if they are few."""
    terms = terms.withColumn("part", part_of(F.col("term"), index.parts))
    own = _of_parts(index.terms, terms) if few else index.terms
    return terms.join(own, ["part", "lang", "term"]).join(F.broadcast(index.stats), "lang")


def _matches(terms: DataFrame, index: Index, allowed: DataFrame | None) -> DataFrame:
    own = terms.withColumn("part", part_of(F.col("term"), index.parts))
    found = _of_parts(index.postings, own).join(known_terms(terms, index), ["part", "lang", "term"])
    return found if allowed is None else found.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")


def _idf() -> Column:
    return F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _bm25() -> Column:
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return F.col("weight") * _idf() * part


def _tfidf() -> Column:
    return F.col("weight") * (1 + F.ln("tf")) * F.ln(F.col("n_docs") / F.col("df"))


def term_overlap(terms: DataFrame, index: Index, allowed: DataFrame | None = None) -> DataFrame:
    found = _matches(terms, index, allowed)
    return found.groupBy("query_id", "doc_id").agg(F.count("term").cast("double").alias("score"))


def tfidf(terms: DataFrame, index: Index, allowed: DataFrame | None = None) -> DataFrame:
    found = _matches(terms, index, allowed)
    return found.groupBy("query_id", "doc_id").agg(F.sum(_tfidf()).alias("score"))


def bm25(terms: DataFrame, index: Index, allowed: DataFrame | None = None) -> DataFrame:
    """Weights may be counts or any other weights; a document without a length is left out."""
    found = _matches(terms, index, allowed).filter("len is not null")
    return found.groupBy("query_id", "doc_id").agg(F.sum(_bm25()).alias("score"))


def hybrid(terms: DataFrame, index: Index, allowed: DataFrame | None = None) -> DataFrame:
    """0.8 BM25 + 0.2 TF-IDF, each over its best score among all matches; then the filter."""
    both = _matches(terms, index, None).groupBy("query_id", "doc_id").agg(F.sum(_bm25()).alias("b"), F.sum(_tfidf()).alias("t"))
    best = both.groupBy("query_id").agg(F.coalesce(F.max("b"), F.lit(1.0)).alias("b1"), F.max("t").alias("t1"))
    score = HYBRID * F.try_divide(F.coalesce("b", F.lit(0.0)), F.col("b1")) + (1 - HYBRID) * F.try_divide("t", "t1")
    out = both.join(best, "query_id").select("query_id", "doc_id", score.alias("score"))
    return out if allowed is None else out.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi").select("query_id", "doc_id", "score")


def top(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Adds ``rank`` by (score at 9 digits, id) and keeps the first k."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("rank") <= k)


def expansion(terms: DataFrame, first: DataFrame, tokens: DataFrame, index: Index) -> DataFrame:
    """Query terms with weight 1 and the three best new terms of the feedback documents.

    first: (query_id, doc_id, rank) of the feedback documents; tokens: (doc_id,
    lang, tokens). A new term's score is its mean count there times its BM25
    idf, its weight half of that over the best score; ties go to the term that
    stands first in the feedback texts. A best score of 0 leaves no new terms.
    """
    lang = terms.select("query_id", "lang").distinct()
    texts = first.select("query_id", "doc_id", "rank").join(lang, "query_id").join(tokens, ["doc_id", "lang"])
    size = texts.groupBy("query_id").agg(F.count("*").alias("n_texts"))
    words = texts.select("query_id", "lang", "rank", F.posexplode("tokens").alias("pos", "term"))
    pool = words.groupBy("query_id", "lang", "term").agg(F.count("*").alias("tf"), F.min(F.struct("rank", "pos")).alias("at"))
    pool = pool.join(terms.select("query_id", "term"), ["query_id", "term"], "left_anti").join(size, "query_id")
    pool = known_terms(pool, index, few=False).withColumn("s", F.col("tf") / F.col("n_texts") * _idf())
    own = Window.partitionBy("query_id")
    best = pool.withColumns({"r": F.row_number().over(own.orderBy(F.desc("s"), "at")), "s1": F.max("s").over(own)}).filter(F.col("r") <= FEEDBACK_TERMS)
    new = best.select("query_id", "lang", "term", (F.try_divide("s", "s1") * BETA).alias("weight")).filter("weight is not null")
    return terms.select("query_id", "lang", "term", F.lit(ALPHA).alias("weight")).unionByName(new)


def with_feedback(terms: DataFrame, index: Index, tokens: DataFrame, allowed: DataFrame | None = None, first=bm25) -> DataFrame:
    """BM25 again with expanded queries; the feedback comes from the whole corpus.

    The expanded queries are stored: the second pass reads them for its terms and for its list of parts.
    """
    feedback = top(first(terms, index), FEEDBACK_DOCS)
    return bm25(stored(expansion(terms, feedback, tokens, index)), index, allowed)


def best_match(terms: DataFrame, index: Index, first: str = "en") -> DataFrame:
    """The best document of each query: of the first language that has one, ``first`` and then by name.

    All languages are ranked at once, each pair of query and language by
    itself, as scores of different languages don't compare.
    """
    found = _matches(terms, index, None).filter("len is not null").groupBy("query_id", "lang", "doc_id").agg(F.sum(_bm25()).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("lang") != first, "lang", F.desc(F.round("score", 9)), "doc_id")
    return found.withColumn("n", F.row_number().over(order)).filter("n = 1").select("query_id", "doc_id", "score")


def fused(lexical: DataFrame, dense: DataFrame, k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; ties stand in the order lexical, then dense."""
    both = lexical.select("query_id", "doc_id", "rank", F.lit(0).alias("list")).unionByName(dense.select("query_id", "doc_id", "rank", F.lit(1).alias("list")))
    one = both.groupBy("query_id", "doc_id").agg(
        F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"),
        F.min(F.when(F.col("list") == 0, F.col("rank"))).alias("lexical_rank"), F.min(F.when(F.col("list") == 1, F.col("rank"))).alias("dense_rank"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("dense_rank"))
    return one.withColumn("rank", F.row_number().over(order)).select("query_id", "doc_id", "score", "rank")


def result_page(ranked: DataFrame, docs: DataFrame, chapters: DataFrame, k: int = 15) -> DataFrame:
    """Ranked documents with their texts and chapter; ids without a document are skipped."""
    return (
        ranked.filter(F.col("rank") <= k).join(docs, "doc_id").join(chapters, ["book", "chapter_number"], "left")
        .select("query_id", "rank", "doc_id", "book", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("grade", F.lit("Unknown")).alias("grade"), F.coalesce("text", F.lit("")).alias("text"))
    )


def together(runs: dict[str, DataFrame], covered: dict[str, list[str]] | None = None, languages: DataFrame | None = None) -> DataFrame:
    """One run table (system, query_id, doc_id, rank, score) of many methods.

    covered: the languages of methods that have limits; such methods keep the
    queries that ``languages`` (query_id, lang) gives one of theirs.
    """
    parts = []
    for name, df in runs.items():
        if name in (covered or {}):
            own = languages.filter(F.col("lang").isin(covered[name])).select("query_id").distinct()
            df = df.join(own, "query_id", "left_semi")
        parts.append(df.select(F.lit(name).alias("system"), "query_id", "doc_id", "rank", "score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
