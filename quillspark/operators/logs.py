"""Request logs: parsing, counts, latency histograms, quantiles and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG = "ts timestamp, level string, msg string, request_id string, method string, path string, status int, duration_ms double, client string"
#: Upper edges of the latency buckets, in seconds.
EDGES = (0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 10.0, 30.0)
#: Routes that are not measured.
HEALTH = ("/metrics", "/api/v1/health")


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound log rows of JSON lines (value), and the lines that are none."""
    rows = lines.select("value", F.from_json("value", LOG, {"mode": "PERMISSIVE"}).alias("r"))
    ok = F.col("r").isNotNull() & F.col("r.ts").isNotNull() & F.col("r.path").isNotNull() & F.col("r.status").isNotNull()
    return rows.filter(ok).select("r.*"), rows.filter(F.coalesce(~ok, F.lit(True))).select("value")


def request_counts(log: DataFrame, size: str = "1 hour") -> DataFrame:
    """(start, path, status, n) of tumbling windows, health checks left out; batch or stream."""
    own = log.filter(~F.col("path").isin(*HEALTH))
    return own.groupBy(F.window("ts", size).alias("w"), "path", "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "path", "status", "n")


def _buckets() -> list[Column]:
    seconds = F.col("duration_ms") / 1000
    return [F.count_if(seconds <= e).alias(f"le_{i}") for i, e in enumerate(EDGES)]


def histogram(log: DataFrame) -> DataFrame:
    """(path, edge, n) cumulative; the edge of the last bucket is infinite."""
    h = log.groupBy("path").agg(*_buckets(), F.count("*").alias("all"), F.round(F.sum(F.col("duration_ms") / 1000), 6).alias("sum"))
    cells = [F.struct(F.lit(e).alias("edge"), F.col(f"le_{i}").alias("n")) for i, e in enumerate(EDGES)] + [F.struct(F.lit(float("inf")).alias("edge"), F.col("all").alias("n"))]
    return h.select("path", F.inline(F.array(*cells)))


def quantile(q: float) -> Column:
    """The q-quantile within the bucket columns, linear inside a bucket; the last edge beyond it."""
    goal = F.lit(q) * F.col("all")
    out = F.lit(EDGES[-1])
    for i in range(len(EDGES) - 1, -1, -1):
        low, under = (F.lit(0.0), F.lit(0)) if i == 0 else (F.lit(EDGES[i - 1]), F.col(f"le_{i - 1}"))
        out = F.when(F.col(f"le_{i}") >= goal, low + (EDGES[i] - low) * F.coalesce(F.try_divide(goal - under, F.col(f"le_{i}") - under), F.lit(0.0))).otherwise(out)
    return out


def latency_alerts(log: DataFrame, q: float = 0.95, limit: float = 2.0, size: str = "5 minutes", step: str = "1 minute", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, start, n, quantile, alert) of sliding windows; batch or stream."""
    h = log.groupBy(*by, F.window("ts", size, step).alias("w")).agg(*_buckets(), F.count("*").alias("all"))
    return h.select(*by, F.col("w.start").alias("start"), F.window_time("w").alias("at"), F.col("all").alias("n"), F.round(quantile(q), 6).alias("quantile")).withColumn("alert", F.col("quantile") > limit)


def rate_alerts(log: DataFrame, size: str = "5 minutes", step: str = "1 minute", by: tuple[str, ...] = ()) -> DataFrame:
    """Error and busy shares of sliding windows: over 2 % 5xx but 503 and over 0.1 requests a second; over 5 % 503."""
    failed = (F.col("status") >= 500) & (F.col("status") != 503)
    h = log.groupBy(*by, F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"), F.count_if(F.col("status") == 503).alias("busy"))
    rate = F.col("n") / (F.unix_timestamp("w.end") - F.unix_timestamp("w.start"))
    return h.select(
        *by, F.col("w.start").alias("start"), F.window_time("w").alias("at"), "n", "failed", "busy",
        ((F.col("failed") / F.col("n") > 0.02) & (rate > 0.1)).alias("error_alert"), (F.col("busy") / F.col("n") > 0.05).alias("busy_alert"),
    )


def lasting(alerts: DataFrame, flag: str, minutes: int = 10, step: int = 60, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, from, until, n): stretches of windows, one a step, that all hold a flag for some minutes."""
    on = alerts.filter(F.col(flag)).select(*by, "start").withColumn("s", F.unix_timestamp("start"))
    # the day splits the runs' numbering; runs over midnight are joined below
    run = on.withColumn("day", F.floor(F.col("s") / 86400))
    rank = F.row_number().over(Window.partitionBy(*by, "day").orderBy("s"))
    parts = run.withColumn("g", F.col("s") - rank * step).groupBy(*by, "day", "g").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy("a")  # one row a run
    linked = parts.withColumn("new", F.coalesce((F.col("a") - F.lag("b").over(order) > step).cast("int"), F.lit(1))).withColumn("id", F.sum("new").over(order))
    out = linked.groupBy(*by, "id").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"))
    return out.filter((F.col("b") - F.col("a") + step) >= minutes * 60).select(*by, F.timestamp_seconds("a").alias("from"), F.timestamp_seconds("b").alias("until"), "n")


def method_summary(log: DataFrame, by: str = "path") -> DataFrame:
    """Requests, failures, rate and nearest-rank percentiles of each method; null times don't count in the last.

    Times are counted by value and numbered within each millisecond, to which
    the counts of the milliseconds before are added: no task holds a method's log.
    """
    span = F.greatest(F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts")), F.lit(1))
    whole = log.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 500).alias("failures"), F.round(F.count("*") / span, 6).alias("rps"))
    times = log.filter("duration_ms is not null").groupBy(by, F.floor("duration_ms").alias("ms"), "duration_ms").agg(F.count("*").alias("same"))
    order = Window.partitionBy(by).orderBy("ms")
    steps = times.groupBy(by, "ms").agg(F.sum("same").alias("here")).withColumns({"before": F.sum("here").over(order) - F.col("here"), "timed": F.sum("here").over(Window.partitionBy(by))}).drop("here")
    upto = F.col("before") + F.sum("same").over(Window.partitionBy(by, "ms").orderBy("duration_ms"))
    placed = times.join(steps, [by, "ms"]).withColumn("upto", upto)
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("timed")), F.col("duration_ms")))
    return whole.join(placed.groupBy(by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99")), by, "left")
