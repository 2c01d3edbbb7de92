"""Commits by compare-and-set: racing writers, lost updates, older versions."""

import threading

import pytest
from pyspark.sql import functions as F

from quillspark.sources import store


def run_together(*jobs):
    failed = []

    def guarded(job):
        try:
            job()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=guarded, args=(j,)) for j in jobs]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return failed


def test_only_one_of_many_creates_a_file(spark):
    root, won = store.workspace(spark), []
    jobs = [lambda i=i: won.append(i) if store.create_if_absent(spark, f"{root}/log/1", str(i)) else None for i in range(8)]
    assert run_together(*jobs) == [] and len(won) == 1
    assert store.read_text(spark, f"{root}/log/1") == str(won[0]) and store.names(spark, f"{root}/log") == ["1"]


def test_a_stale_base_is_refused(spark):
    root = store.workspace(spark)
    store.replace(spark.range(3), root)
    store.commit(spark, root, "v=other", 1, 0)
    with pytest.raises(store.Conflict):
        store.commit(spark, root, "v=mine", 1, 0)


def test_no_update_is_lost(spark):
    root = store.workspace(spark)
    store.replace(spark.range(1).withColumn("by", F.lit(-1)), root)
    add = lambda i: store.update(spark, root, lambda df: df.unionByName(spark.range(1).withColumn("by", F.lit(i))))
    assert run_together(*[lambda i=i: add(i) for i in range(4)]) == []
    assert sorted(r["by"] for r in store.live(spark, root).collect()) == [-1, 0, 1, 2, 3]
    assert store.versions(spark, root) == [1, 2, 3, 4, 5]


def test_two_replacements_at_once_are_both_versions(spark):
    root = store.workspace(spark)
    assert run_together(*[lambda n=n: store.replace(spark.range(n), root) for n in (2, 3)]) == []
    assert {store.live(spark, root, v).count() for v in (1, 2)} == {2, 3}
    with pytest.raises(ValueError):
        store.replace(spark.range(1), root, least=2)
    assert store.versions(spark, root) == [1, 2]


def test_no_version_yet(spark):
    with pytest.raises(ValueError):
        store.live(spark, store.workspace(spark))
