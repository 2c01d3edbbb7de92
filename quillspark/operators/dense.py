"""Exact vector search, vector maintenance and pluggable encoders and scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIM = 64


def unit(v: Column, dim: int = DIM) -> Column:
    """The first ``dim`` components at length 1 (lengths below 1e-12 count as that); null if there are fewer."""
    cut = F.transform(F.slice(v, 1, dim), lambda x: x.cast("double"))
    long = F.transform(F.array(cut), lambda c: F.transform(c, lambda x: x / F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-12))))[0]
    return F.when(F.size(v) >= dim, long)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Rows of vectors and of queries in one product: 8 MB of scores at most.
ROWS, QUERIES = 4096, 256
#: Blocks of queries that are broadcast: at most 256 KB each at 128 components.
BROADCAST_BLOCKS = 32


def _flat(vectors: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _packed(vectors: DataFrame) -> DataFrame:
    """(ids, cells): up to ROWS vectors of a partition in one row; nothing moves."""
    kind = dict(vectors.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([one(some.column(0)), one(some.column(1).flatten())], names=["ids", "cells"])

    return vectors.select("doc_id", "vector").mapInArrow(run, f"ids array<{kind}>, cells array<double>")


def cosine_scores(queries: DataFrame, vectors: DataFrame, allowed: DataFrame | None = None, block: int = QUERIES, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every query and vector, or of what may be among a query's k best; both need ``vector`` of length 1.

    Vectors are packed into matrices where they lie, queries into blocks by a
    hash of their id. Each pair of blocks is one matrix product, of which only
    the k best of each query leave it. A few blocks of queries are broadcast;
    more are joined by their number, to which the packed vectors are copied.
    Null vectors take no part.
    """
    if allowed is not None:
        vectors = vectors.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    q = queries.select("query_id", "vector").filter("vector is not null")
    blocks = max(1, -(-q.count() // block))
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    asked = q.groupBy(number.alias("b")).agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = _packed(vectors.filter("vector is not null")).withColumn("b", every)
    pairs = rows.join(F.broadcast(asked) if blocks <= BROADCAST_BLOCKS and block <= QUERIES else asked, "b").select("ids", "cells", "asked")
    kinds = dict(q.dtypes)["query_id"], dict(vectors.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, cells, asked = (batch.column(c).slice(i, 1).flatten() for c in range(3))
                names, wanted = asked.field(0), _flat(asked.field(1))
                scores = wanted @ cells.to_numpy(zero_copy_only=False).reshape(len(ids), -1).T
                query, row = _best(np.round(scores, 9), ids, k or len(ids))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), ids.take(pa.array(row)), pa.array(scores[query, row])], names=["query_id", "doc_id", "score"])

    return pairs.mapInArrow(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of the k best vectors of each query, by score at 9 digits, then by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return cosine_scores(queries, vectors, allowed, k=k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def _best(scores: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the cells that may be among a query's k best: all above its k-th score, and of its ties the smallest ids."""
    if scores.shape[1] <= k:
        return np.divmod(np.arange(scores.size), scores.shape[1])
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
    query, row = np.nonzero(scores >= edge)
    if len(query) > k * len(scores):  # ties at the edge
        place = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable").argsort()
        order = np.lexsort((place[row], -scores[query, row], query))
        query, row = query[order], row[order]
        start = np.searchsorted(query, query)
        query, row = query[np.arange(len(query)) - start < k], row[np.arange(len(row)) - start < k]
    return query, row


def rescored(candidates: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine scores of given (query_id, doc_id) pairs only."""
    pairs = candidates.select("query_id", "doc_id").join(vectors, "doc_id").join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    return pairs.filter("vector is not null and q is not null").select("query_id", "doc_id", dot(F.col("vector"), F.col("q")).alias("score"))


def by_language(queries: DataFrame, covered: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Queries that an encoder covers, and the others with a reason."""
    ok = F.col("lang").isin(list(covered))
    return queries.filter(ok), queries.filter(~ok).withColumn("reason", F.lit("language not covered"))


def encode(texts: DataFrame, factory: Callable[[], Callable[[list[str]], list[list[float]]]], id_col: str = "doc_id", dim: int | None = None) -> DataFrame:
    """(id, vector) by a user's encoder, made once in each worker; each text encoded once.

    Rows are sorted by length within partitions, so that batches pad little.
    """
    distinct = texts.select("text").distinct().withColumn("n", F.length("text")).sortWithinPartitions("n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for pdf in batches:
            made = encoder(pdf["text"].tolist())
            if len(made) != len(pdf) or (dim and any(len(v) != dim for v in made)):
                raise ValueError("the encoder returned another number of vectors or components")
            yield pd.DataFrame({"text": pdf["text"], "vector": made})

    return texts.select(id_col, "text").join(distinct.mapInPandas(run, "text string, vector array<double>"), "text").select(id_col, "vector")


def cross_reranked(candidates: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], k: int) -> DataFrame:
    """Candidates (query_id, doc_id, rank) by a user's score of query and text; those without text are left out."""
    score = F.pandas_udf(scorer, "double")
    pairs = candidates.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(docs.select("doc_id", "text").filter("text is not null and text <> ''"), "doc_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "old")
    out = pairs.select("query_id", "doc_id", F.col("rank").alias("old"), score("query", "text").alias("score"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def kept_releases(releases: DataFrame, protected: DataFrame, keep: int = 3) -> DataFrame:
    """(release, kept): the newest ``keep`` and the protected ones."""
    rank = F.row_number().over(Window.orderBy(F.desc("created_at"), "release"))
    safe = protected.select("release", F.lit(True).alias("safe"))
    return releases.withColumn("r", rank).join(F.broadcast(safe), "release", "left").select("release", ((F.col("r") <= keep) | F.coalesce("safe", F.lit(False))).alias("kept"))


def upserted(old: DataFrame, new: DataFrame, dim: int, most: int = 20) -> DataFrame:
    """Vectors (doc_id, vector) with new ones in place of old ones of the same id; fails if a new vector has another length.

    Of several new vectors of an id one counts. A null vector replaces an old one
    too; searches leave it out.
    """
    bad = [r["doc_id"] for r in new.filter(F.col("vector").isNotNull() & (F.size("vector") != dim)).select("doc_id").limit(most).collect()]
    if bad:
        raise ValueError(f"vectors without {dim} components: {sorted(bad)}")
    one = new.groupBy("doc_id").agg(F.min("vector").alias("vector"))
    return old.select("doc_id", "vector").join(one, "doc_id", "left_anti").unionByName(one)


def release_report(releases: DataFrame, vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """(release, created_at, vectors, missing, strange, complete): a release is complete if it has one vector for every document and no other.

    releases: (release, created_at); vectors: (release, doc_id, vector).
    """
    ids = docs.select("doc_id").distinct()
    expected = ids.agg(F.count("*").alias("expected"))
    own = vectors.filter("vector is not null").select("release", "doc_id").distinct()
    found = own.join(ids.withColumn("known", F.lit(1)), "doc_id", "left").groupBy("release").agg(F.count("*").alias("vectors"), F.count("known").alias("known"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = releases.select("release", "created_at").join(found, "release", "left").join(F.broadcast(expected))  # one row
    out = out.select("release", "created_at", zero("vectors").alias("vectors"), (F.col("expected") - zero("known")).alias("missing"), (zero("vectors") - zero("known")).alias("strange"))
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("strange") == 0))


def chosen_release(report: DataFrame, wanted: str | None = None) -> str:
    """The wanted release, or the newest complete one (ties: the first by name); fails if there is none or the wanted one isn't complete."""
    rows = report if wanted is None else report.filter(F.col("release") == wanted)
    best = rows.filter("complete").orderBy(F.desc("created_at"), "release").select("release").first()
    if best is None:
        raise ValueError("no complete release" if wanted is None else f"release {wanted} is unknown or not complete")
    return best["release"]
