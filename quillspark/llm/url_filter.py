"""URL filters: rules first, else a logistic regression on hashed character n-grams.

Host and path n-grams (3 to 5 characters, marked by the part they come from)
are hashed into 2**16 indicators. The model is fitted on a small labelled URL
table; scoring is a map over the rows without a shuffle, so a host with a third
of all rows costs no more than any other.

Defined results: a null url or one without ``://`` has an empty host and path
and gets the verdict of the method for these; repeated rows give repeated
results; a null id stays null; further columns don't matter; an empty table
gives an empty result; very long urls are read whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_labels import ALLOWED, BLOCKED

BUCKETS = 2**16
SIZES = (3, 4, 5)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule as struct(size, rule, verdict), null if none fits."""
    fits = []
    for rule, verdict in rules:
        own, slash, rest = rule.partition("/")
        hit = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        fits.append(F.when(hit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def _grams(part: str, text: Column) -> Column:
    marked = F.concat(F.lit("<"), text, F.lit(">"))

    def of(n: int) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.length(marked) - (n - 1)), lambda i: F.concat(F.lit(f"{part}:"), F.substring(marked, i, F.lit(n))))
        return F.when(F.length(marked) >= n, own).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in SIZES])


def features(urls: DataFrame) -> DataFrame:
    """Adds the hashed indicators of the columns host and path."""
    grams = urls.withColumn("grams", F.concat(_grams("h", F.col("host")), _grams("p", F.col("path"))))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features").transform(grams).drop("grams")


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled URL table: url, label (1: to be blocked)."""
    rows = ", ".join(f"('{u}', {y}D)" for urls, y in ((BLOCKED, 1), (ALLOWED, 0)) for u in urls)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")


def fit(labels: DataFrame) -> LogisticRegressionModel:
    """labels: url, label. L2-regularised logistic regression."""
    parts = features(labels.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label")).coalesce(1)
    return LogisticRegression(maxIter=60, regParam=0.003, standardization=False).fit(parts)


def judge(pages: DataFrame, model: LogisticRegressionModel, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict and the model's score of every row."""
    url = F.col(url_col)
    parts = features(pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path")))
    scored = model.transform(parts).withColumn("score", vector_to_array("probability")[1]).withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    return scored.select(
        id_col, "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score",
    )
