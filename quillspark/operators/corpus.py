"""Corpus curation: dimensions, reconstruction of fields, drops with audits, flat view."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stopwords import ARABIC
from ..functions.text import arabic_token, clean, has_text, provenance, without_marks, without_prefix, without_suffix
from ..sources.store import workspace

PARTS = ("full", "isnad", "matn")


def flat(docs: DataFrame, chapters: DataFrame, books: DataFrame, prepared: DataFrame) -> DataFrame:
    """Documents with chapter titles, book names and prepared texts; Spark broadcasts the sides that are small."""
    return docs.join(chapters, ["book", "chapter_number"], "left").join(books, "book", "left").join(prepared, "id", "left")


def aliased(view: DataFrame, names: dict[str, str]) -> DataFrame:
    """Further names for columns."""
    return view.withColumns({new: F.col(old) for new, old in names.items()})


def dimensions(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books, chapters, documents) of flat rows; fails if a chapter has two titles."""
    chapters = rows.select("book", "chapter_number", "title").distinct()
    twice = chapters.groupBy("book", "chapter_number").count().filter("count > 1")
    bad = [tuple(r)[:2] for r in twice.limit(5).collect()]
    if bad:
        raise ValueError(f"chapters with several titles: {bad}")
    return rows.select("book").distinct(), chapters, rows.drop("title")


def reconstructed(rows: DataFrame, langs: tuple[str, ...] = ("en",)) -> DataFrame:
    """Fill full, matn and isnad from the two others, in this order, and say so in ``*_source``.

    Columns are named like ``en_full``; later steps see what earlier ones filled.
    """
    for lang in langs:
        full, isnad, matn = (f"{lang}_{p}" for p in PARTS)
        rows = rows.withColumns({c: clean(F.col(c)) for c in (full, isnad, matn)} | {f"{c}_source": provenance(F.col(c)) for c in (full, isnad, matn)})
        steps = (
            (full, F.trim(F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in (isnad, matn)])), "reconstructed_from_isnad_matn"),
            (matn, without_prefix(F.col(full), F.col(isnad)), "reconstructed_from_full_minus_isnad"),
            (isnad, without_suffix(F.col(full), F.col(matn)), "reconstructed_from_full_minus_matn"),
        )
        for column, value, source in steps:
            use = (F.col(column) == "") & (value != "")
            rows = rows.withColumns({column: F.when(use, value).otherwise(F.col(column)), f"{column}_source": F.when(use, F.lit(source)).otherwise(F.col(f"{column}_source"))})
    return rows


def reconstruction_counts(rows: DataFrame, langs: tuple[str, ...] = ("en",)) -> DataFrame:
    """(lang, part, n) of reconstructed fields; all combinations stand, with 0 too."""
    counts = [F.struct(F.lit(lang).alias("lang"), F.lit(p).alias("part"), F.count_if(F.startswith(F.col(f"{lang}_{p}_source"), F.lit("reconstructed"))).alias("n")) for lang in langs for p in PARTS]
    return rows.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def content_flags(rows: DataFrame, langs: tuple[str, ...] = ("en",)) -> DataFrame:
    """Adds has_<lang>_content (any part) and has_<lang>_matn."""
    flags = {}
    for lang in langs:
        parts = [has_text(F.col(f"{lang}_{p}")) for p in PARTS]
        flags |= {f"has_{lang}_content": reduce(Column.__or__, parts), f"has_{lang}_matn": parts[-1]}
    return rows.withColumns(flags)


def renumbered(rows: DataFrame, order: list[str], name: str, root: str | None = None) -> DataFrame:
    """Dense numbers from 1 in a global order: a range sort, then offsets of its partitions.

    The sorted rows are stored with their partition's number first, as a range
    sort that runs again may draw other bounds.
    """
    spark = rows.sparkSession
    part = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()})
    root = root or workspace(spark)
    part.withColumn("__i", F.col("__m") - F.shiftleft(F.col("__p").cast("long"), 33)).drop("__m").write.parquet(root)
    part = spark.read.parquet(root)
    sizes = part.groupBy("__p").agg(F.count("*").alias("n"))
    before = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row a partition
    return part.join(F.broadcast(before), "__p").withColumn(name, F.col("__i") + F.col("__before") + 1).drop("__p", "__i", "__before")


def split_by(rows: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and the dropped ones for the audit."""
    keep = F.coalesce(keep, F.lit(False))
    return rows.filter(keep), rows.filter(~keep)


def empty_audit(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(what, n): rows with an empty column, for each and for any of them."""
    empty = {c: ~has_text(F.col(c)) for c in columns}
    counts = [F.struct(F.lit(c).alias("what"), F.count_if(e).alias("n")) for c, e in empty.items()]
    counts.append(F.struct(F.lit("any").alias("what"), F.count_if(reduce(Column.__or__, empty.values())).alias("n")))
    return rows.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def prepared(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """All prepared texts in one projection: joined tokens by name."""
    return rows.select("id", *[F.array_join(tokens, " ").alias(name) for name, tokens in columns.items()])


def lemmatised(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """doc_id, lang and tokens with their lemmas; tokens without a lemma stay as they are.

    lemmas: (token, lemma), unique and broadcast, as a language's table has a bound.
    """
    long = tokens.select("doc_id", "lang", F.posexplode_outer("tokens").alias("pos", "token")).join(F.broadcast(lemmas), "token", "left")
    word = F.struct("pos", F.coalesce("lemma", "token").alias("w"))
    return long.groupBy("doc_id", "lang").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), word))), lambda s: s["w"]).alias("tokens"))


#: Parts of speech that carry no topic.
STOP_POS = ("prep", "conj", "part", "punc")


def analysed(tokens: DataFrame, analyses: DataFrame, stop: Iterable[str] = ARABIC, stop_pos: Iterable[str] = STOP_POS) -> DataFrame:
    """doc_id, lang and Arabic tokens by their analyses, in order.

    analyses: (token, lemma, pos), the best analysis of each token that has one;
    of several rows for a token one counts, by lemma and part of speech. The
    lemma's normal form stands for the token, unless its part of speech is left
    out. A token without an analysis stays itself, without marks: it is held
    against the stop words before letters are unified, as the original does. Both
    need two letters and are no stop words. Stop words are normalised like tokens.
    """
    stop = [x for (x,) in tokens.sparkSession.createDataFrame([(w,) for w in stop], "w string").select(arabic_token(F.col("w"))).collect()]  # a fixed list
    best = analyses.filter("token is not null").groupBy("token").agg(F.min(F.struct("lemma", "pos")).alias("best"))
    long = tokens.select("doc_id", "lang", F.posexplode_outer("tokens").alias("pos", "token")).join(best, "token", "left")
    raw = without_marks(F.col("token"))
    known = F.col("best").isNotNull()
    lemma = arabic_token(F.col("best.lemma"))
    ok = F.when(known, ~F.coalesce(F.col("best.pos"), F.lit("")).isin(*stop_pos) & (F.length(lemma) >= 2) & ~lemma.isin(stop)).otherwise((F.length(raw) >= 2) & ~raw.isin(stop))
    word = F.when(F.coalesce(ok, F.lit(False)), F.struct("pos", F.when(known, lemma).otherwise(arabic_token(raw)).alias("w")))
    return long.groupBy("doc_id", "lang").agg(F.transform(F.array_sort(F.collect_list(word)), lambda s: s["w"]).alias("tokens"))
