"""Sharding by size-tiered compaction under a versioned manifest.

``append`` writes arrivals as they come, one small immutable shard for each
partition, and commits a manifest that also lists them. ``compact`` sorts the
shards below the target size into tiers of similar size (each tier holds sizes
within a factor of ``fan_in``), joins neighbours of a tier into groups of about
the target size, rewrites each group of two or more as one file and commits the
next manifest. Tiers with fewer than ``fan_in`` shards wait for more arrivals,
so a row is rewritten about once for each tier. Old shards are left untouched
until ``vacuum``, so readers of an older version are not disturbed.

A manifest is a Parquet folder of one row for each shard. It is written aside
and becomes version n + 1 by one rename without overwriting: a reader sees all
of a version or nothing, and of two writers one has to retry. (On stores
without an atomic rename another commit step is needed.)

The rows of the shards to be merged are shuffled once, and each target file is
a task of its own, dealt by its number; a file larger than the rest doesn't
arise, as groups are cut by size. Group sizes
follow from file sizes alone, so a source with a third of all rows makes more
files, not larger ones.

Defined results: rows are kept as they are, with nulls, empty and very long
texts, repeated rows and further columns (a column ``shard`` or ``version`` of
the input is replaced in what ``read`` returns, any other name stays); an empty
table gives a manifest without shards and reads as no rows of its columns.
"""

from __future__ import annotations

import math
import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder

TARGET = 128 * 2**20
SMALLEST = 2**16
FAN_IN = 4
#: Up to so many shards (about 200 bytes each) the map to new files is broadcast.
MAP_IN_ALL = 100_000
MANIFEST = "shard string, folder string, tier int, n_rows long, bytes long, version int"


def tier_of(size: Column, fan_in: int = FAN_IN, smallest: int = SMALLEST) -> Column:
    """0 up to the smallest size, and one more for each factor of fan_in."""
    return F.greatest(F.lit(0), F.floor(F.ln(size / F.lit(float(smallest))) / math.log(fan_in)).cast("int"))


class Shards:
    """A folder of shards and its manifests."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target, fan_in

    def _path(self, name: str) -> JavaObject:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _store(self) -> JavaObject:
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        store, top = self._store(), self._path("manifest")
        found = [x.getPath().getName() for x in store.listStatus(top)] if store.exists(top) else []
        return max([int(x[2:]) for x in found if x.startswith("v=")], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.sql("SELECT '' AS shard, '' AS folder, 0 AS tier, 0L AS n_rows, 0L AS bytes, 0 AS version WHERE false")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v={version:08d}")

    def _commit(self, shards: DataFrame, version: int) -> int:
        aside = f"aside-{uuid.uuid4().hex}"
        shards.write.parquet(f"{self.root}/{aside}")
        jvm, final = self.spark._jvm, self._path(f"manifest/v={version:08d}")
        self._store().mkdirs(self._path("manifest"))
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        once = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        once[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # unlike FileSystem.rename, this fails if the target exists
        try:
            files.rename(self._path(aside), final, once)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e):
                raise
            raise RuntimeError(f"version {version} was committed by another writer; read the manifest again and retry") from e
        return version

    def _rows(self, folders: list[str]) -> tuple[DataFrame, str]:
        """The rows of some folders with the file's path below the root, and that column's name, which is no other column's."""
        rows = self.spark.read.option("recursiveFileLookup", True).parquet(*[f"{self.root}/{f}" for f in folders])
        name = "_shard"
        while name in rows.columns:
            name += "_"
        return rows.withColumn(name, F.regexp_extract("_metadata.file_path", r"(data-\d{8}-[0-9a-f]{8}/.*)$", 1)), name

    def _written(self, folder: str, version: int) -> DataFrame:
        """A row for each file of a folder, from the files' own metadata."""
        rows = self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.root}/{folder}")
        path = F.regexp_extract("_metadata.file_path", r"(data-\d{8}-[0-9a-f]{8}/.*)$", 1)
        shards = rows.groupBy(path.alias("shard"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("n_rows"))
        tier = tier_of(F.col("bytes"), self.fan_in)
        return shards.select("shard", F.lit(folder).alias("folder"), tier.alias("tier"), "n_rows", "bytes", F.lit(version).alias("version"))

    def append(self, docs: DataFrame) -> int:
        """Write arrivals as small shards and commit them; the new version."""
        version = self.version() + 1
        folder = f"data-{version:08d}-{uuid.uuid4().hex[:8]}"
        docs.limit(0).write.mode("ignore").parquet(f"{self.root}/columns")  # for reads without a shard
        docs.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self._commit(self.manifest(version - 1).unionByName(self._written(folder, version)), version)

    def plan(self) -> DataFrame:
        """The manifest with ``file``: the new file of each shard to be merged, else null."""
        tier = Window.partitionBy("tier").orderBy("shard")
        before = F.sum("bytes").over(tier.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes")
        small = F.col("bytes") < self.target
        shards = self.manifest().withColumn("tier", F.when(small, F.col("tier")).otherwise(F.lit(1_000)))
        shards = shards.withColumn("slot", F.floor(before / self.target)).withColumn("waits", F.count("*").over(Window.partitionBy("tier")) < self.fan_in)
        alone = F.count("*").over(Window.partitionBy("tier", "slot")) < 2
        file = F.when(small & ~F.col("waits") & ~alone, F.format_string("t%02d-%06d", "tier", "slot"))
        return shards.withColumn("file", file).drop("slot", "waits")

    def compact(self) -> int:
        """Merge similarly sized shards once through all tiers; the version that then holds."""
        version = self.version() + 1
        planned = self.plan()
        merging = planned.filter("file is not null").select("folder", "shard", "file")
        n, files = merging.agg(F.count("*"), F.count_distinct("file")).first()
        if not n:
            return version - 1
        folder = f"data-{version:08d}-{uuid.uuid4().hex[:8]}"
        folders = [f for (f,) in merging.select("folder").distinct().collect()]  # one for each commit that still has shards
        rows, name = self._rows(folders)
        number = f"{name}n"
        while number in rows.columns:
            number += "_"
        # one row for each file of the target size, numbered from 0
        numbers = merging.select("file").distinct().select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias(number))
        to = merging.join(numbers, "file").select(F.col("shard").alias(name), number)
        rows = rows.join(F.broadcast(to) if n <= MAP_IN_ALL else to, name)
        rows.repartitionById(files, F.col(number)).drop(name, number).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        kept = planned.filter("file is null").drop("file").join(self.manifest().select("shard", F.col("tier").alias("own")), "shard").withColumn("tier", F.col("own")).drop("own")
        return self._commit(kept.unionByName(self._written(folder, version)), version)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with ``shard`` (file name) and ``version`` (of the read)."""
        version = self.version() if version is None else version
        shards = self.manifest(version)
        folders = [f for (f,) in shards.select("folder").distinct().collect()]
        if not folders:
            empty = self.spark.read.parquet(f"{self.root}/columns")
            return empty.withColumns({"shard": F.lit(""), "version": F.lit(version)})
        rows, name = self._rows(folders)
        names = shards.select(F.col("shard").alias(name))
        rows = rows.join(F.broadcast(names) if shards.count() <= MAP_IN_ALL else names, name, "left_semi")
        return rows.withColumns({"shard": F.col(name), "version": F.lit(version)}).drop(name)

    def vacuum(self) -> int:
        """Delete the folders that the latest manifest doesn't list; their number."""
        used = {f for (f,) in self.manifest().select("folder").distinct().collect()}
        store, gone = self._store(), 0
        for x in store.listStatus(self._path("")):
            name = x.getPath().getName()
            if name.startswith("data-") and name not in used:
                gone += bool(store.delete(x.getPath(), True))
        return gone


def sharded(docs: DataFrame, root: str | None = None, target: int = TARGET, fan_in: int = FAN_IN, rounds: int = 2) -> DataFrame:
    """Append all rows, compact ``rounds`` times, and read the committed version.

    Without a root the shards are the call's own, and no older version is kept.
    """
    spark = docs.sparkSession
    shards = Shards(spark, root or f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}", target, fan_in)
    shards.append(docs)
    for _ in range(rounds):
        shards.compact()
    if root is None:
        shards.vacuum()
    return shards.read()
