"""File sources: corpus CSV folders and JSON files of queries, judgments and pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def corpus_csv(spark: SparkSession, root: str, columns: Sequence[str], encodings: Sequence[str] = ("UTF-8", "windows-1256")) -> DataFrame:
    """All CSV files below a folder with one subfolder for each book.

    Files that are no valid UTF-8 are read in the second encoding. Adds ``book``
    and ``file``; fails if a file lacks one of the columns.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
    kinds = files.select("path", F.is_valid_utf8("content").alias("utf8")).collect()
    parts = []
    for utf8, encoding in zip((True, False), encodings):
        paths = [k["path"] for k in kinds if k["utf8"] == utf8]
        if paths:
            if not utf8:
                spark.conf.set("spark.sql.legacy.javaCharsets", "true")
            df = spark.read.option("header", True).option("multiLine", True).option("encoding", encoding).csv(paths)
            df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
            missing = set(columns) - set(df.columns)
            if missing:
                raise ValueError(f"columns are missing: {sorted(missing)}")
            parts.append(df.select(*columns, F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("book"), F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file")))
    if not parts:
        raise ValueError(f"no CSV file below {root}")
    return reduce(DataFrame.unionByName, parts)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Old column names give way to new ones where the new value is null."""
    for old, new in names.items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)).drop(old)
    return df


def queries_json(spark: SparkSession, path: str) -> DataFrame:
    """{query id: text} as (query_id, text)."""
    whole = spark.read.option("wholetext", True).text(path)
    kind = T.MapType(T.StringType(), T.StringType())
    return whole.select(F.explode(F.from_json("value", kind)).alias("query_id", "text"))


def qrels_json(spark: SparkSession, path: str) -> DataFrame:
    """{query id: {"grades": {doc id: grade}}} as (query_id, doc_id, grade)."""
    whole = spark.read.option("wholetext", True).text(path)
    kind = T.MapType(T.StringType(), T.StructType().add("grades", T.MapType(T.StringType(), T.IntegerType())))
    long = whole.select(F.explode(F.from_json("value", kind)).alias("query_id", "judged"))
    return long.select("query_id", F.explode("judged.grades").alias("doc_id", "grade")).withColumn("doc_id", F.col("doc_id").cast("long"))


def pairs_json(spark: SparkSession, path: str) -> DataFrame:
    """[{query, text, label}] as rows; incomplete entries are left out."""
    return spark.read.schema("query string, text string, label double").option("multiLine", True).json(path).dropna()
