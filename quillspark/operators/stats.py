"""Significance tests and comparisons over long metric tables (system, query_id, metric, value)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), 1e-300)
    h = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_p_value(t: float, n: int) -> float:
    """Two-sided p of a paired t statistic of n pairs."""
    return beta_share((n - 1) / 2, 0.5, (n - 1) / (n - 1 + t * t))


def wilcoxon_p_value(w: float, n: int, ties: float, zeros: bool) -> float:
    """Two-sided p of the smaller rank sum of n non-zero differences.

    Exact up to 50 differences without ties and zeros, else the normal
    approximation; ties is the sum of t^3 - t over groups of equal ranks.
    """
    if n <= 50 and not ties and not zeros:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else 1.0


def compared(metrics: DataFrame, baseline: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a, b, metric, query_id, x, y): each system against the baseline, or all pairs if it is absent.

    Pairs of systems with different numbers of values are dropped.
    """
    m = metrics.filter("query_id <> 'MEAN'") if dict(metrics.dtypes)["query_id"] == "string" else metrics
    has = m.filter(F.col("system") == baseline).limit(1).count() > 0
    n = F.count("*").over(Window.partitionBy(*keys, "system", "metric"))
    m = m.withColumn("n", n)
    a = m.select(*keys, "metric", "query_id", F.col("system").alias("a"), F.col("value").alias("x"), F.col("n").alias("na"))
    b = m.select(*keys, "metric", "query_id", F.col("system").alias("b"), F.col("value").alias("y"), F.col("n").alias("nb"))
    pairs = a.join(b, [*keys, "metric", "query_id"]).filter("na = nb")
    pairs = pairs.filter((F.col("b") == baseline) & (F.col("a") != baseline)) if has else pairs.filter("a < b")
    return pairs.select(*keys, "a", "b", "metric", "query_id", "x", "y")


def t_tests(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """t, p, mean difference, direction and a note for each pair and metric."""
    d = F.col("x") - F.col("y")
    own = [*keys, "a", "b", "metric"]
    s = pairs.groupBy(*own).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    s = s.withColumn("t", F.when((F.col("n") >= 2) & (F.col("sd") > 1e-15), F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))))

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else t_p_value(x, int(k)) for x, k in zip(t, n)], dtype="float64")

    note = F.when(F.col("n") < 2, "insufficient data")
    return s.select(*own, "n", "mean_diff", F.signum("mean_diff").cast("int").alias("direction"), "t", p("t", "n").alias("p_value"), note.alias("note"))


def wilcoxon_tests(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The smaller signed-rank sum and p for each pair and metric; all differences zero gives p = 1."""
    own = [*keys, "a", "b", "metric"]
    d = pairs.withColumn("d", F.round(F.col("x") - F.col("y"), 12))
    some = Window.partitionBy(*own, F.col("d") == 0)
    size = F.abs("d")
    tie = F.count("*").over(Window.partitionBy(*own, F.col("d") == 0, size))
    r = d.withColumns({"r": F.rank().over(some.orderBy(size)) + (tie - 1) / 2, "tie": tie})
    live = F.col("d") != 0
    s = r.groupBy(*own).agg(F.count("*").alias("n"), F.count_if(live).alias("m"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("down"), F.sum(F.when(live, F.col("tie") * F.col("tie") - 1.0).otherwise(0.0)).alias("ties"))

    @F.pandas_udf("double")
    def p(w: pd.Series, m: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([1.0 if k == 0 else wilcoxon_p_value(x, int(k), t, k < a) for x, k, a, t in zip(w, m, n, ties)], dtype="float64")

    w = F.least("up", "down")
    ok = F.col("n") >= 2
    return s.select(*own, "n", F.when(ok & (F.col("m") > 0), w).alias("w"), F.when(ok, p(w, "m", "n", "ties")).alias("p_value"), F.when(~ok, "insufficient data").when(F.col("m") == 0, "all differences are zero").alias("note"))


#: Values are resampled as whole numbers of this part, so that sums don't depend on their order.
PART = 1_000_000


def draw(seed: int, round_: Column, place: Column, n: Column) -> Column:
    """The position, from 0, that a round draws for a place: follows from md5 alone, so SQL can repeat it."""
    text = F.concat_ws("|", F.lit(str(seed)), round_.cast("string"), place.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def bootstrap(metrics: DataFrame, rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """(system, metric, mean, lower, upper, std): percentile intervals (2.5 and 97.5, linear) of resampled means.

    A round draws as many positions as there are queries; all systems and
    metrics of as many values share its draws. Rounds are dealt over tasks and
    joined with the values by position; sums are partial before they move.
    Values count to their sixth digit. Fewer than two values give their mean.
    """
    own = Window.partitionBy("system", "metric")
    values = metrics.filter("value is not null").select("system", "metric", F.round(F.col("value") * PART).cast("long").alias("v"), "value", (F.row_number().over(own.orderBy("query_id")) - 1).cast("long").alias("at"), F.count("*").over(own).alias("n"))
    sizes = values.select("n").distinct()
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), m - 1))
    tries = sizes.withColumn("round", every(F.lit(rounds).cast("long"))).repartition("n", "round").withColumn("place", every(F.col("n")))
    drawn = tries.withColumn("at", draw(seed, F.col("round"), F.col("place"), F.col("n"))).groupBy("n", "round", "at").agg(F.count("*").alias("times"))
    sums = drawn.join(values, ["n", "at"]).groupBy("system", "metric", "round").agg(F.sum(F.col("times") * F.col("v")).alias("s"))
    ranked = sums.withColumn("r", F.row_number().over(own.orderBy("s")))  # as many rows as rounds
    # linear percentiles of whole numbers: thousandths of the way from one to the next
    spot = {name: divmod(per_mille * (rounds - 1), 1000) for name, per_mille in (("lower", 25), ("upper", 975))}
    at = lambda r: F.max(F.when(F.col("r") == r, F.col("s")))
    edges = ranked.groupBy("system", "metric").agg(*[(at(low + 1) * (1000 - part) + at(min(low + 2, rounds)) * part).alias(name) for name, (low, part) in spot.items()])
    base = values.groupBy("system", "metric").agg((F.sum("v") / (F.count("*") * PART)).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"), F.count("*").alias("n"))
    edge = lambda c: F.when(F.col("n") < 2, F.col("mean")).otherwise(F.col(c) / (F.col("n") * (1000 * PART))).alias(c)
    return base.join(edges, ["system", "metric"]).select("system", "metric", "mean", edge("lower"), edge("upper"), "std")


def best_systems(means: DataFrame, order: list[str]) -> DataFrame:
    """(metric, system, mean): the best of each metric; ties go to the system that stands first in ``order``."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("system"))
    return means.groupBy("metric").agg(F.max_by(F.struct("system", "mean"), F.struct("mean", -place)).alias("b")).select("metric", "b.system", "b.mean")


def marked(tests: DataFrame) -> DataFrame:
    """Adds ``mark``: ** below 0.01, * below 0.05, else empty."""
    return tests.withColumn("mark", F.when(F.col("p_value") < 0.01, "**").when(F.col("p_value") < 0.05, "*").otherwise(""))


def deltas(means: DataFrame, baseline: str) -> DataFrame:
    """(variant, system, metric, baseline, value, delta, delta_pct) of (variant, system, metric, mean)."""
    base = means.filter(F.col("variant") == baseline).select("system", "metric", F.col("mean").alias("baseline"))
    d = means.filter(F.col("variant") != baseline).join(base, ["system", "metric"])
    pct = F.when(F.col("baseline") > 0, (F.col("mean") - F.col("baseline")) / F.col("baseline") * 100).otherwise(0.0)
    return d.select("variant", "system", "metric", "baseline", F.col("mean").alias("value"), F.round(F.col("mean") - F.col("baseline"), 6).alias("delta"), F.round(pct, 2).alias("delta_pct"))


def average_deltas(table: DataFrame) -> DataFrame:
    return table.groupBy("variant", "metric").agg(F.round(F.avg("delta_pct"), 2).alias("delta_pct"))


def ranked_variants(averages: DataFrame) -> DataFrame:
    out = averages.groupBy("variant").agg(F.round(F.avg("delta_pct"), 2).alias("delta_pct"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("delta_pct"), "variant")))
