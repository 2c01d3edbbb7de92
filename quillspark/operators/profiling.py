"""Corpus profile: counts, coverage, lengths, duplicates, feasibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, grade_flags, has_text, normal_grade, without_prefix, without_suffix


def counts(rows: DataFrame, by: str, most: int | None = None) -> DataFrame:
    """(value, n), nulls counted as (missing); the largest first if cut."""
    out = rows.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("(missing)")).alias("value")).agg(F.count("*").alias("n"))
    return out if most is None else out.orderBy(F.desc("n"), "value").limit(most)


def tally(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(what, n) of many conditions in one pass."""
    cells = [F.struct(F.lit(name).alias("what"), F.count_if(c).alias("n")) for name, c in named.items()]
    return rows.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def grade_diagnostics(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Missing and recovered grades of two fields."""
    x, y = ~has_text(F.col(a)), ~has_text(F.col(b))
    known = normal_grade(F.col(a), F.col(b)) != "Unknown"
    return tally(rows, {"a missing": x, "b missing": y, "both missing": x & y, "a missing, recovered": x & ~y & known, "b missing, recovered": ~x & y & known, "unknown": ~known})


def unknown_reasons(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(reason, a, b, n) of rows without a grade, the 30 most frequent pairs of raw values."""
    x, y = ~has_text(F.col(a)), ~has_text(F.col(b))
    many = F.size(F.array_union(grade_flags(F.col(a)), grade_flags(F.col(b)))) > 1
    reason = F.when(x & y, "missing both").when(many, "conflict").when(x, "a missing, b not recognised").when(y, "b missing, a not recognised").otherwise("not recognised")
    unknown = rows.filter(normal_grade(F.col(a), F.col(b)) == "Unknown").select(reason.alias("reason"), clean(F.col(a)).alias("a"), clean(F.col(b)).alias("b"))
    return unknown.groupBy("reason", "a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason", "a", "b").limit(30)


def coverage(rows: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(book, column, filled, n): for each column and book, and for all books, in one pass."""
    long = rows.select(F.col(by).alias("book"), *[clean(F.col(c).cast("string")).alias(c) for c in columns]).unpivot(["book"], columns, "column", "value")
    g = long.groupingSets([[F.col("column"), F.col("book")], [F.col("column")]], "column", "book").agg(F.grouping("book").alias("g"), F.count_if(F.col("value") != "").alias("filled"), F.count("*").alias("n"))
    return g.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("book")).alias("book"), "column", "filled", "n")


def length_stats(rows: DataFrame, column: str, by: str) -> DataFrame:
    """Word counts by group: min, quartiles, 90th percentile, max, mean."""
    n = F.size(F.filter(F.split(F.coalesce(F.col(column), F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != ""))
    q = F.percentile("len", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    s = rows.select(F.col(by).alias("group"), n.alias("len")).groupBy("group").agg(F.min("len").alias("min"), q.alias("q"), F.max("len").alias("max"), F.round(F.avg("len"), 4).alias("mean"))
    return s.select("group", "min", *[F.round(F.get("q", i), 4).alias(name) for i, name in enumerate(("p25", "p50", "p75", "p90"))], "max", "mean")


def duplicate_counts(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(key, n): rows that share a non-empty key with another row, all of them counted."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.md5(c).alias("h"), (c != "").alias("some")) for k, c in keys.items()])).alias("s")).select("s.*")
    sizes = long.filter("some").groupBy("key", "h").agg(F.count("*").alias("n"))
    return sizes.groupBy("key").agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n"))


def feasibility(rows: DataFrame, full: str, isnad: str, matn: str) -> DataFrame:
    """How many fields are missing and could be rebuilt from the others."""
    f, i, m = (has_text(F.col(c)) for c in (full, isnad, matn))
    rest, start = without_prefix(F.col(full), F.col(isnad)) != "", without_suffix(F.col(full), F.col(matn)) != ""
    return tally(rows, {
        "full missing": ~f, "full missing, isnad and matn": ~f & i & m, "full missing, isnad only": ~f & i & ~m, "full missing, matn only": ~f & ~i & m, "full missing, none": ~f & ~i & ~m, "full rebuildable": ~f & (i | m),
        "matn missing": ~m, "matn missing, full": ~m & f, "matn missing, isnad": ~m & i, "matn missing, full and isnad": ~m & f & i, "matn rebuildable": ~m & f & i & rest,
        "isnad missing": ~i, "isnad missing, full": ~i & f, "isnad missing, matn": ~i & m, "isnad missing, full and matn": ~i & f & m, "isnad rebuildable": ~i & f & m & start,
    })


def samples(rows: DataFrame, cases: dict[str, Column], order: str, most: int = 5) -> DataFrame:
    """(case, id): the first rows of each case."""
    long = rows.select(order, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in cases.items()]))).alias("case"))
    return long.withColumn("r", F.row_number().over(Window.partitionBy("case").orderBy(order))).filter(F.col("r") <= most).select("case", F.col(order).alias("id"))
