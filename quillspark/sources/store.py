"""Versioned tables: each write is a new version, committed by creating the next number in a log."""

from __future__ import annotations

import json
import random
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def workspace(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, locally a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table that several parts of a plan read, and read it back: it is made once, and a lost executor costs a re-read."""
    path = workspace(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    fs, p = _at(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that doesn't exist yet; False if another writer was first.

    The content is written under a name of its own and then gets the wanted name
    in one step of the file system that fails if it is taken: a rename, which
    HDFS doesn't let overwrite, or on local disks, where it would, a hard link.
    """
    fs, p = _at(spark, path)
    jvm = spark._jvm
    if fs.exists(p):
        return False
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if fs.getScheme() != "file":
            return fs.rename(draft, p)
        local = lambda x: jvm.java.io.File(x.toUri().getPath()).toPath()
        jvm.java.nio.file.Files.createLink(local(p), local(draft))
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" not in str(e.java_exception):
            raise
        return False
    finally:
        fs.delete(draft, False)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change was made from."""


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed version numbers of a table, ascending."""
    return sorted(int(x) for x in names(spark, f"{root}/log") if x.isdigit())


def commit(spark: SparkSession, root: str, data: str, base: int, n_rows: int) -> int:
    """Make a written folder the version after ``base``; ``Conflict`` if there is one already."""
    if not create_if_absent(spark, f"{root}/log/{base + 1}", json.dumps({"data": data, "n_rows": n_rows})):
        raise Conflict(f"version {base + 1} of {root} exists")
    return base + 1


def _written(df: DataFrame, root: str, least: int) -> tuple[str, int]:
    data = f"v={uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{data}")
    n = df.sparkSession.read.parquet(f"{root}/{data}").count()
    if n < least:
        raise ValueError(f"{n} rows, at least {least} are expected; the live version stays")
    return data, n


def replace(df: DataFrame, root: str, least: int = 0, tries: int = 100) -> int:
    """Write a new version, check its rows, then commit it behind the newest one; the version's number.

    The rows don't depend on older versions: a writer that loses a race commits
    the same files as the next version.
    """
    data, n = _written(df, root, least)
    for _ in range(tries):
        try:
            return commit(df.sparkSession, root, data, max(versions(df.sparkSession, root), default=0), n)
        except Conflict:
            time.sleep(random.random() / 20)
    raise Conflict(f"{tries} other writers were faster")


def update(spark: SparkSession, root: str, change, least: int = 0, tries: int = 100) -> int:
    """Commit ``change(live rows)`` behind the version that it was made from; made anew after a lost race."""
    for _ in range(tries):
        base = max(versions(spark, root), default=0)
        data, n = _written(change(live(spark, root, base)), root, least)
        try:
            return commit(spark, root, data, base, n)
        except Conflict:
            time.sleep(random.random() / 20)
    raise Conflict(f"{tries} other writers were faster")


def live(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of the newest committed version, or of an older one."""
    at = version or max(versions(spark, root), default=0)
    if not at:
        raise ValueError(f"{root} has no version")
    return spark.read.parquet(f"{root}/{json.loads(read_text(spark, f'{root}/log/{at}'))['data']}")


def guarded_union(parts: list[DataFrame], least: int) -> DataFrame:
    """All parts by column name; fails if they have fewer rows than expected."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    n = whole.count()
    if n < least:
        raise ValueError(f"{n} rows, at least {least} are expected")
    return whole


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__new")))
    return both.withColumn("__rank", rank).filter("__rank = 1").drop("__new", "__rank")


def archive(df: DataFrame, root: str, run_ts: str) -> None:
    """A run's results as JSON under its time stamp; older runs stay."""
    df.withColumn("run_ts", F.lit(run_ts)).write.mode("append").partitionBy("run_ts").json(root)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows that point at no parent; empty after a sound rebuild."""
    return children.join(parents.select(key).distinct(), key, "left_anti")
