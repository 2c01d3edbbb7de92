"""The same aggregations as streams, and upsert streams of labels and statuses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.logs import latency_alerts, rate_alerts, request_counts
from ..sources import store

#: Processors with state and timers need this store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def read(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def counts(log: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Request counts once their window is past the watermark; repeated request ids count once."""
    return request_counts(log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"]), size)


def latencies(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    return latency_alerts(log.withWatermark("ts", late))


class _Stretches(StatefulProcessor):
    """Of one key: since when a condition holds, its last window and their number; a timer ends a stretch.

    A window comes once its end is past the watermark, so windows of later
    batches are later. The timer goes off when the window after the last one
    would have come: then no window can prolong the stretch.
    """

    def __init__(self, by: tuple[str, ...], seconds: int, step: int, size: int) -> None:
        self.by, self.seconds, self.step, self.size = by, seconds, step, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stretch = handle.getValueState("stretch", "since long, last long, n long")

    def _out(self, key: tuple, stretches: list[tuple[int, int, int]]) -> pd.DataFrame:
        long = [(*key, pd.Timestamp(a, unit="s"), pd.Timestamp(b, unit="s"), n) for a, b, n in stretches if b - a + self.step >= self.seconds]
        return pd.DataFrame(long, columns=[*self.by, "from", "until", "n"])

    def _end(self, last: int) -> int:
        return (last + self.step + self.size) * 1000

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = tuple(self.stretch.get()) if self.stretch.exists() else None
        if now:
            self.handle.deleteTimer(self._end(now[1]))
        closed = []
        for s in sorted({int(x) for pdf in rows for x in pdf["s"]}):
            if now and s - now[1] <= self.step:
                now = (now[0], s, now[2] + 1)
            else:
                closed += [now] if now else []
                now = (s, s, 1)
        self.stretch.update(now)
        self.handle.registerTimer(self._end(now[1]))
        yield self._out(key, closed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ended = [tuple(self.stretch.get())] if self.stretch.exists() else []
        self.stretch.clear()
        yield self._out(key, ended)

    def close(self) -> None:
        pass


def lasting(log: DataFrame, alerts=rate_alerts, flag: str = "busy_alert", by: tuple[str, ...] = ("path",), minutes: int = 10, late: str = "10 minutes", size: int = 300, step: int = 60) -> DataFrame:
    """(by, from, until, n): stretches of windows of ``size`` seconds, one a ``step``, that all hold an alert's flag for some minutes.

    The stream's form of ``operators.logs.lasting``: windows are aggregated
    first and let out by the watermark, then each key keeps one stretch as
    state. Rows may come in any order within ``late``. Run it with STATE_STORE.
    """
    windows = alerts(log.withWatermark("ts", late), size=f"{size} seconds", step=f"{step} seconds", by=by)
    on = windows.filter(F.col(flag)).select(*by, "at", F.unix_timestamp("start").alias("s"))
    kinds = dict(log.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "`from` timestamp", "until timestamp", "n long"])
    return on.groupBy(*by).transformWithStateInPandas(_Stretches(by, minutes * 60, step, size), schema, "Append", "EventTime")


def finish(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", conf: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over what is there into Parquet and read the result.

    The second run has no new rows: it lets out what the last rows' watermark
    closes. conf holds for this stream only.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        for _ in range(2):
            stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(stream.schema).parquet(out)


def upsert(events: DataFrame, keys: list[str], value: str, root: str, checkpoint: str, buckets: int = 64) -> DataFrame:
    """The latest ``value`` by (event_time, event_id) of each key, kept up to date by micro-batches.

    The state lies in buckets by a hash of the key. A batch rewrites only the
    buckets that it touches, as files under its own number, then commits the
    number with the list of newest files of all buckets: a batch that runs again
    starts from the commit before it and writes the same, and readers see whole
    commits only. Numbers of buckets must stay the same over a state's life.
    """
    spark = events.sparkSession
    last = F.struct("event_time", "event_id", value)
    row = events.select(*keys, last.alias("s")).schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def files(session: SparkSession, at: dict[int, int], some: list[int]) -> DataFrame:
        held = [f"{root}/{at[b]}/bucket={b}" for b in some if b in at]
        return session.read.schema(row).parquet(*held) if held else session.createDataFrame([], row)

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        at = _newest(session, root, before=number)
        new = batch.select(*keys, last.alias("s"), bucket.alias("bucket"))
        touched = sorted(b for (b,) in new.select("bucket").distinct().collect())  # at most all buckets
        whole = new.unionByName(files(session, at, touched).withColumn("bucket", bucket))
        merged = whole.groupBy("bucket", *keys).agg(F.max("s").alias("s"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{number}")
        at |= dict.fromkeys(touched, number)
        session.createDataFrame(sorted(at.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/{number}")

    events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    at = _newest(spark, root)
    return files(spark, at, sorted(at)).select(*keys, f"s.{value}", F.col("s.event_time").alias("updated_at"))


def _newest(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """The batch that wrote each bucket last, by the newest commit (before a batch)."""
    done = [int(x) for x in store.names(spark, f"{root}/commits") if x.isdigit() and store.exists(spark, f"{root}/commits/{x}/_SUCCESS")]
    done = [x for x in done if before is None or x < before]
    return {r["bucket"]: r["batch"] for r in spark.read.parquet(f"{root}/commits/{max(done)}").collect()} if done else {}
