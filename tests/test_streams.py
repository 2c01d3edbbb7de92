"""Streams against their batch forms: late rows, restarts, what a batch rewrites."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quillspark.operators import logs as lo
from quillspark.sources import store
from quillspark.streaming import logs as live

KINDS = "ts timestamp, path string, status int, request_id string, duration_ms double"
START = dt.datetime(2024, 3, 1)


def requests(seed, n=900, minutes=600):
    """Three routes; each is busy for stretches of minutes."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at = r.uniform(0, minutes)
        path = r.choice(["/a", "/b", "/c"])
        busy = (at // 25) % 3 == ord(path[1]) % 3
        rows.append((START + dt.timedelta(minutes=at), path, 503 if busy and r.random() < 0.8 else 200, str(i), 10.0))
    return sorted(rows)


def write(spark, root, rows, files):
    """Rows as files in the order of arrival: up to 8 minutes after their time."""
    r = random.Random(1)
    late = sorted(rows, key=lambda x: x[0] + dt.timedelta(minutes=r.uniform(0, 8)))
    size = -(-len(late) // files)
    for i in range(0, len(late), size):
        part = late[i : i + size]
        r.shuffle(part)
        spark.createDataFrame(part, KINDS).coalesce(1).write.mode("append").parquet(root)


def rows_of(df):
    return sorted((r["path"], r["from"], r["until"], r["n"]) for r in df.collect())


def closed(spark, rows, minutes=10):
    """The batch form's stretches that end before the last watermark."""
    whole = rows_of(lo.lasting(lo.rate_alerts(spark.createDataFrame(rows, KINDS), by=("path",)), "busy_alert", minutes, by=("path",)))
    end = rows[-1][0] - dt.timedelta(minutes=10)
    return [x for x in whole if x[2] + dt.timedelta(seconds=360) <= end]


def test_lasting_alerts_equal_the_batch_rows(spark):
    rows = requests(2)
    root, out, checkpoint = (store.workspace(spark) for _ in range(3))
    write(spark, root, rows, 5)
    got = live.finish(live.lasting(live.read(spark, root, spark.createDataFrame([], KINDS).schema)), out, checkpoint, conf=live.STATE_STORE)
    want = closed(spark, rows)
    assert rows_of(got) == want and len(want) > 5
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != live.STATE_STORE["spark.sql.streaming.stateStore.providerClass"]


def test_lasting_alerts_go_on_after_a_restart(spark):
    rows = requests(4)
    root, out, checkpoint = (store.workspace(spark) for _ in range(3))
    schema = spark.createDataFrame([], KINDS).schema
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):  # the second run finds the state of the first
        write(spark, root, part, 2)
        got = live.finish(live.lasting(live.read(spark, root, schema)), out, checkpoint, conf=live.STATE_STORE)
    assert rows_of(got) == closed(spark, rows)


EVENTS = "event_id long, annotator_id int, query_id string, doc_id long, label int, event_time timestamp"


def events(ids, docs):
    return [(i, i % 3, "q", docs[i % len(docs)], i % 3, START + dt.timedelta(seconds=i)) for i in ids]


def test_a_batch_rewrites_only_the_buckets_it_touches(spark):
    root, state, checkpoint = (store.workspace(spark) for _ in range(3))
    schema = spark.createDataFrame([], EVENTS).schema
    keys = ["annotator_id", "query_id", "doc_id"]
    for part in (events(range(300), list(range(100))), events(range(300, 303), [5]), events(range(303, 306), [5000])):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(root)
        got = live.upsert(live.read(spark, root, schema), keys, "label", state, checkpoint, buckets=16)
    want = spark.read.schema(schema).parquet(root).groupBy(*keys).agg(F.max_by("label", F.struct("event_time", "event_id")).alias("label"))
    cells = lambda df: sorted(map(tuple, df.select(*keys, "label").collect()))
    assert cells(got) == cells(want)
    written = [len([x for x in store.names(spark, f"{state}/{b}") if x.startswith("bucket=")]) for b in range(3)]
    assert written[0] == 16 and written[1] <= 3 and written[2] <= 3


def test_a_batch_that_runs_again_writes_the_same(spark):
    root, state, checkpoint = (store.workspace(spark) for _ in range(3))
    schema = spark.createDataFrame([], EVENTS).schema
    keys = ["doc_id"]
    spark.createDataFrame(events(range(50), list(range(20))), EVENTS).coalesce(1).write.mode("append").parquet(root)
    first = sorted(map(tuple, live.upsert(live.read(spark, root, schema), keys, "label", state, checkpoint).collect()))
    again = sorted(map(tuple, live.upsert(live.read(spark, root, schema), keys, "label", state, store.workspace(spark)).collect()))
    assert first == again and live._newest(spark, state, before=0) == {}


def test_no_rows_yet(spark):
    root, state = store.workspace(spark), store.workspace(spark)
    empty = spark.createDataFrame([], EVENTS)
    empty.write.parquet(root)
    assert live.upsert(live.read(spark, root, empty.schema), ["doc_id"], "label", state, store.workspace(spark)).count() == 0
