"""Exact top-k search over an impact-ordered, score-at-a-time index.

Vectors become integers, floor(256 x), and rows are dealt into blocks of
bounded size. The index is a stored table of posting segments, one for each
block, quantised impact and dimension: the rows whose component has that
impact, with its values. The impact of a component is the band of its
magnitude, half an octave wide. Beside them stand the norm of what each row has
below each impact, and the vectors for rescoring.

Queries meet each block in groups of bounded size. A group adds the segments to
its accumulators in descending order of impact, those of one impact by one
product. By Cauchy and Schwarz a row
can still gain or lose at most the norm of its unread components times that of
the query in the dimensions that the row was not met in. A query stops once
this proves that few rows may be among its k best; these are scored
exactly, and its lower segments are not read. The best k of each block meet in
one window. ``walked`` returns the components read beside the results.

The work is queries x rows at most, as an exact search's is; it spreads over as
many tasks as there are pairs of query and row blocks, and no task holds more
than one such pair.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part; shorter vectors count as followed by zeros; a row is
no candidate of a query with the same id; repeated query rows count once, and
repeated rows are separate candidates; of different vectors with a query's id
the smallest is the query, and each is a candidate; an empty table gives an
empty result; null ids take no part; further columns don't matter. Sums of
products are exact: where they could leave the whole numbers that doubles hold,
bounds allow for the rounding and Python's integers give the scores. A score
beyond a long counts as the largest or smallest long.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 5
QUERY_BLOCK = 8192
#: Components of a block of rows, about.
BLOCK_VALUES = 1 << 20
#: Quantised impacts, half an octave each; the lowest takes all that is smaller.
IMPACTS = 14
#: A query stops at one possible member in so many rows, or at so many times k.
RESCORED, RESCORED_K = 32, 8
_FORWARD = -1
_SEGMENT = "block long, impact int, dim int, rows array<long>, values array<double>"
_FOUND = "query_id long, vec_id long, score long, read long, postings long"
_STEP = 128
_TRIED, _WORTH = 16, 2
_GROUPS = 512
_PAIRS = 200_000


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _distinct(ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors, only the k + 1 smallest ids (k rows of each) can be members."""
    _, same = np.unique(rows, axis=0, return_inverse=True)
    at = pd.DataFrame({"same": same.reshape(-1), "id": ids}).sort_values(["same", "id"], kind="stable")
    copy = at.groupby(["same", "id"]).cumcount()
    rank = at.groupby("same")["id"].rank("dense")
    keep = np.sort(at.index[(copy < k) & (rank <= k + 1)])
    return ids[keep], rows[keep]


def _exact(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray, sound: bool) -> np.ndarray:
    """The scores of the pairs (row of q, row of x) as longs."""
    if sound:
        parts = [np.einsum("ij,ij->i", q[row[i : i + _PAIRS]], x[col[i : i + _PAIRS]]) for i in range(0, max(len(row), 1), _PAIRS)]
        return np.concatenate(parts).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(q[i], x[j])) for i, j in zip(row, col)]
    return np.array([max(min(s, 2**63 - 1), -(2**63)) for s in whole], np.int64)


def _kth(low: np.ndarray, k: int) -> np.ndarray:
    """A value that k rows of each column reach: the k-th largest of the groups' largest ones."""
    if len(low) < k:
        return np.full(low.shape[1], -np.inf)
    most = np.maximum.reduceat(low, np.arange(0, len(low), max(1, len(low) // max(_GROUPS, k))), axis=0)
    return np.partition(most, len(most) - k, axis=0)[len(most) - k]


def segments(block: int, vid: np.ndarray, x: np.ndarray) -> pd.DataFrame:
    """A block's posting segments, norms below each impact (dim -1) and vectors (impact -1), by descending impact."""
    size = np.abs(x)
    top = size.max(initial=0.0) or 1.0
    with np.errstate(divide="ignore"):
        impact = np.clip(np.floor(IMPACTS + 2 * np.log2(size / top)), 0, IMPACTS - 1).astype(np.int64)
    impact[size == 0] = IMPACTS  # no posting
    parts = (size / top) ** 2
    out = []
    for level in range(IMPACTS - 1, -1, -1):
        for dim in range(x.shape[1]):
            rows = np.flatnonzero(impact[:, dim] == level)
            if len(rows):
                out.append((block, level, dim, rows, x[rows, dim]))
        out.append((block, level, -1, [], top * np.sqrt(np.where(impact < level, parts, 0.0).sum(1))))
    out.append((block, _FORWARD, -1, vid, x.reshape(-1)))
    return pd.DataFrame(out, columns=["block", "impact", "dim", "rows", "values"])


def _levels(index: pd.DataFrame, n: int, width: int, kind: type) -> Callable[[int], tuple]:
    """A block's segments of an impact side by side, laid out when a query first reads them: (rows, dimensions, their values, how many)."""
    own = {level: part for level, part in index[index["dim"] >= 0].groupby("impact")}
    laid: dict[int, tuple] = {}

    def level(i: int) -> tuple:
        if i not in laid:
            part = own.get(i, index[:0])
            dims = np.sort(part["dim"].to_numpy(np.int64))
            values = np.zeros((n, len(dims)), kind)
            for dim, rows, v in zip(part["dim"], part["rows"], part["values"]):
                values[np.asarray(rows, np.int64), np.searchsorted(dims, dim)] = v
            some = np.flatnonzero(values.any(1))
            rows = some if len(some) < n // 4 else slice(None)  # all rows, where most have a part
            laid[i] = rows, dims, values[rows], int(np.count_nonzero(values))
        return laid[i]

    return level


def _reached(q: np.ndarray, other: np.ndarray, level: Callable[[int], tuple], norms: dict[int, np.ndarray], few: int, k: int, slack: float, over: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row) of the possible members when each query stops, and the components that it read.

    A proof is tried on every ``_TRIED``-th row first: only a query for which
    these leave few rows is worth the whole one.
    """
    n, kind = other.shape[1], q.dtype
    going, found, read = np.arange(len(q)), [], np.zeros(len(q), np.int64)
    score, met = np.where(other, kind.type(0), kind.type(-np.inf)), np.zeros((len(q), n), kind)
    square = q**2
    whole = square.sum(1)[:, None]

    def ends(rows: slice | np.ndarray, of: slice | np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = bound[rows] * np.sqrt(np.maximum(whole[of] - met[of][:, rows], 0) + kind.type(1e-12) * whole[of]) * kind.type(over) + kind.type(slack)
        # beyond a long all scores are equal
        return np.maximum(np.minimum(score[of][:, rows] - rest, 2.0**63), -(2.0**63)), np.maximum(np.minimum(score[of][:, rows] + rest, 2.0**63), -(2.0**63))

    for i in range(IMPACTS - 1, -1, -1):
        rows, dims, values, postings = level(i)
        if postings:
            score[:, rows] += q[:, dims] @ values.T
            met[:, rows] += square[:, dims] @ (values != 0).astype(kind).T
            read[going] += postings
        bound = norms[i].astype(kind)
        if i:
            low, high = ends(slice(None, None, _TRIED), slice(None), bound)
            worth = np.flatnonzero((high >= low.max(1, keepdims=True)).sum(1) * _TRIED <= _WORTH * few)
        else:
            worth = np.arange(len(going))
        if not len(worth):
            continue
        low, high = ends(slice(None), worth, bound)
        possible = (high >= _kth(low.T, k)[:, None]) & np.isfinite(score[worth])
        done = possible.sum(1) <= few if i else np.ones(len(worth), bool)
        which, hit = np.nonzero(possible[done])
        found.append((going[worth[done]][which], hit))
        stay = np.ones(len(going), bool)
        stay[worth[done]] = False
        if not stay.any():
            break
        if done.any():
            going, score, met, q, square, whole = going[stay], score[stay], met[stay], q[stay], square[stay], whole[stay]
    row, col = (np.concatenate(part) for part in zip(*found))
    return row, col, read


def best(qid: np.ndarray, q: np.ndarray, index: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of a block for each query, ties to the smaller id; with the components read and those that the block has."""
    forward = index[index["impact"] == _FORWARD].iloc[0]
    vid = np.asarray(forward["rows"], np.int64)
    x = np.asarray(forward["values"]).reshape(len(vid), -1)
    own = np.zeros((len(q), x.shape[1]))
    own[:, : q.shape[1]] = q[:, : x.shape[1]]  # what only one side has meets zeros
    q, width = own, x.shape[1]
    norms = {i: np.asarray(v) for i, d, v in zip(index["impact"], index["dim"], index["values"]) if d < 0 and i != _FORWARD}
    ends = max(np.abs(x).max(initial=0.0), np.abs(q).max(initial=0.0))
    most = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(width, 1) if ends < 1e150 else math.inf
    sound = most < 2**53
    # whole numbers up to 2**22, and sums of two with a bound, are exact to 1 in single precision
    single = ends < 2**11 and ends * ends * max(width, 1) <= 2**22
    kind, slack, over = (np.float32, 1.0, 1 + 1e-5) if single else (np.float64, 0.0 if sound else most * 2.0**-50 * width, 1 + 1e-9)
    level = _levels(index, len(vid), width, kind)
    postings = sum(len(rows) for rows, d in zip(index["rows"], index["dim"]) if d >= 0)
    few = max(RESCORED_K * k, len(vid) // RESCORED)
    out = []
    for i in range(0, len(q), _STEP):
        ids, part = qid[i : i + _STEP], q[i : i + _STEP]
        other = ids[:, None] != vid[None, :]
        if not most < 1e300:  # no bound in doubles: all pairs are scored
            row, col = np.nonzero(other)
            read = np.zeros(len(part), np.int64)
        else:
            row, col, read = _reached(part.astype(kind), other, level, norms, few, k, slack, over)
        read += np.bincount(row, minlength=len(part)) * width
        exact = _exact(part, x, row, col, sound)
        by = np.lexsort((vid[col], ~exact, row))
        row, col, exact = row[by], col[by], exact[by]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col, exact = row[keep], col[keep], exact[keep]
        out.append(pd.DataFrame({"query_id": ids[row], "vec_id": vid[col], "score": exact, "read": read[row], "postings": postings}))
    return pd.concat(out)


def _block(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    vid, x = _distinct(rows["id"].to_numpy(), _matrix(rows["vec"], rows["vec"].map(len).max()), k)
    return segments(rows["block"].iloc[0], vid, x)


def _search(queries: pd.DataFrame, index: pd.DataFrame, k: int) -> pd.DataFrame:
    empty = pd.DataFrame({c.split()[0]: np.zeros(0, np.int64) for c in _FOUND.split(", ")})
    if queries.empty or index.empty:
        return empty
    qid, q = queries["id"].to_numpy(), _matrix(queries["vec"], queries["vec"].map(len).max())
    return pd.concat([empty, best(qid, q, index, k)])


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vec (floor(256 x) of each component) of the rows that take part."""
    v = F.col(vec_col)
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    def floored(c):
        y = F.greatest(F.least(F.lit(256.0) * c.cast("double"), F.lit(1.7e308)), F.lit(-1.7e308))
        return F.when(F.abs(y) < F.lit(2.0**52), F.floor(F.when(F.abs(y) < F.lit(2.0**52), y)).cast("double")).otherwise(y)  # larger doubles are whole

    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & sound).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, floored).alias("vec")
    )


def walked(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = K) -> DataFrame:
    """query_id, vec_id, score, read, postings: the k best of each block of rows, for each row whose id is divisible by ``every``.

    read: the components that the query read in that block, rescored ones
    included; postings: those that the block holds.
    """
    rows = quantised(vectors, id_col, vec_col)
    queries = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    n = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max(F.size("vec"))).first()
    size = max(256, BLOCK_VALUES // max(n[2] or 1, 1))
    across, down = max(1, math.ceil(n[1] / QUERY_BLOCK)), max(1, math.ceil(n[0] / size))
    dealt = rows.select("id", "vec", F.pmod(F.monotonically_increasing_id(), F.lit(down)).alias("block"))
    index = stored(dealt.groupBy("block").applyInPandas(lambda own: _block(own, k), _SEGMENT), "impacts")
    cell = (F.col("a").cast("long") * down + F.col("block")).alias("cell")
    q = queries.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(across)).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("block"))
    x = index.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    sides = q.select(cell, "id", "vec").groupBy("cell"), x.select(cell, *index.columns).groupBy("cell")
    return sides[0].cogroup(sides[1]).applyInPandas(lambda a, b: _search(a, b, k), _FOUND)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k best."""
    near = walked(vectors, id_col, vec_col, every, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 50, k: int = K) -> str:
    return f"""
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM (SELECT * FROM v WHERE id % {every} = 0) q JOIN v c ON q.id <> c.id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
