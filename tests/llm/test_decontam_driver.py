"""The SVD of decontamination: its matrices stay with the executors, and its result is the decomposition."""

import numpy as np
from pyspark import SparkContext
from pyspark.sql import functions as F

from quillspark.llm import decontam


def test_only_products_of_columns_reach_the_driver(spark, monkeypatch):
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 3_000, 60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(texts[i].split()[:30])) for i in range(4)], "item_id long, text string")
    sent, summed = [], []

    def broadcast(self, value, real=SparkContext.broadcast):
        sent.append(value)
        return real(self, value)

    def sum_pieces(parts, kind, real=decontam._sum_pieces):
        summed.append(real(parts, kind))
        return summed[-1]

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    monkeypatch.setattr(decontam, "_sum_pieces", sum_pieces)
    found = {tuple(x) for x in decontam.find_leaks(docs, bench).select("doc_id", "item_id").collect()}
    assert found == {(i, i) for i in range(4)}
    assert len(sent) == 1  # the finished projection; three bases of 12 MB before
    assert max(x.nbytes for x in summed) < 2**19  # 12 MB twice before


def test_svd_against_numpy(spark):
    r = np.random.default_rng(6)
    rows, dense = [], np.zeros((60, decontam.BUCKETS))
    for i in range(60):
        own = np.sort(r.choice(decontam.BUCKETS, 12, replace=False))
        dense[i, own] = r.random(12)
        rows.append((i % 3, own.tolist(), dense[i, own].tolist()))
    for part in (rows, rows[:1], []):  # all shares, one, none
        passages = spark.createDataFrame(part, "share int, own array<long>, weight array<double>").repartition(3, F.col("share"))
        blocks, values = decontam.randomised_svd(passages)
        got = {x["block"]: np.frombuffer(x["part"], np.float32).reshape(-1, decontam.RANK) for x in blocks.collect()}
        own = dense[: len(part)]
        want = np.linalg.svd(own, compute_uv=False) if len(part) else np.zeros(0)
        assert np.allclose(values[: len(part)], want, rtol=1e-4) and (values[len(part) :] < 1e-2).all()
        if part:
            assert sorted(got) == list(range(decontam.BUCKETS // decontam._BLOCK))
            v = np.concatenate([got[i] for i in sorted(got)])[:, : len(part)]
            assert np.allclose(v.T @ v, np.eye(len(part)), atol=1e-3)
            assert np.allclose(np.linalg.norm(own @ v, axis=0), want, rtol=1e-3)
