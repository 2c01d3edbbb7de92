"""Quality classifier: Naive Bayes support vectors.

A text becomes the set of its hashed n-grams: words and word pairs, and runs of
one to three token shapes (case, marks around the word, whether it repeats the
token before). Each indicator is scaled by its class log-count ratio, and a
linear hinge-loss model is fitted to the scaled indicators by dual coordinate
descent. A logistic curve on cross-validated margins turns margins into
probabilities.

Labels come from rows whose crc32(id as text) mod 4 is not 2. Counts and model
use at most about ``MOST_ROWS`` of them and ``MOST_BYTES`` of indicators (4
bytes each), drawn by hashes of the id; scoring is a map over all documents that needs no
shuffle. Only the model, 2 MB whatever the input, is sent to the executors.

Defined results: null and empty texts have no indicators and get the model's
intercept as their score; repeated rows get equal scores; a null id is never
held out and never a training row; ids with both labels are left out of
training; without labels of both classes every score is the share of label 1
(1 if there is none); further columns don't matter; an empty table gives an
empty result; long texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, small_batches, stored

BUCKETS = 2**18
MOST_ROWS = 8_000
MOST_BYTES = 64 * 2**20
FOLDS = 4
THRESHOLD = 0.7
SMOOTHING = 1.0
COST = 0.05
EPOCHS = 15


def held_out(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(4)) == 2, F.lit(False))


def _shape(token: str) -> str:
    core = token.strip("".join(c for c in set(token) if not c.isalnum()))
    lead = token[: len(token) - len(token.lstrip("".join(c for c in set(token) if not c.isalnum())))] if core else ""
    tail = token[len(lead) + len(core) :] if core else token
    kind = "d" if core.isdigit() else "U" if core.isupper() and len(core) > 1 else "l" if core.islower() else "T" if core.istitle() else "m" if core else "-"
    return f"{lead[:3]}{kind}{tail[:3]}"


class _Tokens(dict):
    """Token -> (word hash, shape hash), remembered for a bounded number of tokens."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= 500_000:
            self.clear()
        word = token.lower().strip(".,;:!?\"'()")
        pair = self[token] = (zlib.crc32(word.encode("utf-8", "replace")), zlib.crc32(_shape(token).encode("utf-8", "replace")))
        return pair


_tokens = _Tokens()


def indicators(text: str | None) -> np.ndarray:
    """The sorted distinct buckets of a text's n-grams."""
    tokens = (text or "").split()
    if not tokens:
        return np.zeros(0, np.int32)
    pairs = np.array([_tokens[t] for t in tokens], np.uint64)
    word, shape = pairs[:, 0], pairs[:, 1] * np.uint64(2)
    shape[1:] += word[1:] == word[:-1]
    grams = [word, shape + np.uint64(1 << 40)]
    if len(tokens) > 1:
        grams += [word[1:] + word[:-1] * np.uint64(0x9E3779B1) + np.uint64(1 << 41), shape[1:] + shape[:-1] * np.uint64(0x85EBCA77) + np.uint64(1 << 42)]
    if len(tokens) > 2:
        grams.append(shape[2:] + shape[1:-1] * np.uint64(0x85EBCA77) + shape[:-2] * np.uint64(0xC2B2AE3D) + np.uint64(1 << 43))
    return np.unique((mix(np.concatenate(grams)) % np.uint64(BUCKETS)).astype(np.int32))


class Rows:
    """Indicator sets one after another: ``own`` holds all buckets, ``at`` where each row's start."""

    def __init__(self, sizes: Iterable[int], sets: Iterable[np.ndarray]):
        self.at = np.r_[0, np.cumsum(list(sizes), dtype=np.int64)].astype(np.int64)
        self.own = np.empty(self.at[-1], np.int32)
        for i, row in enumerate(sets):
            self.own[self.at[i] : self.at[i + 1]] = row

    def __getitem__(self, i: int) -> np.ndarray:
        return self.own[self.at[i] : self.at[i + 1]]


def _log_ratios(rows: Rows, y: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    counts = []
    for label in (1, 0):
        n = np.full(BUCKETS, SMOOTHING)
        own = [i for i in chosen if y[i] == label]
        for i in own:
            n[rows[i]] += 1  # a row's buckets are distinct
        counts.append(np.log(n / (len(own) + 2 * SMOOTHING)))
    return counts[0] - counts[1]


def _norms(rows: Rows, squares: np.ndarray) -> np.ndarray:
    return np.array([max(np.sqrt(squares[rows[i]].sum()), 1e-9) for i in range(len(rows.at) - 1)])


def _descend(rows: Rows, y: np.ndarray, squares: np.ndarray, norm: np.ndarray, chosen: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; returns weights of the plain indicators and the bias.

    A row's values are its scales over its norm. The weights are kept times
    the scales, so that steps need the squared scales only and no values are stored.
    """
    sign, own = np.where(y == 1, 1.0, -1.0), y[chosen]
    part = {label: len(own) / (2 * max((own == label).sum(), 1)) for label in (0, 1)}
    w, b, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(chosen):
            row = rows[i]
            grad = sign[i] * (w[row].sum() / norm[i] + b) - 1
            new = min(max(alpha[i] - grad / 2.0, 0.0), cost * part[y[i]])  # each row has norm 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[row] += step / norm[i] * squares[row]
                b += step
                alpha[i] = new
    return w, b


def _margins(rows: Rows, norm: np.ndarray, w: np.ndarray, b: float, chosen: np.ndarray) -> np.ndarray:
    return np.array([w[rows[i]].sum() / norm[i] + b for i in chosen])


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y on the margin, by Newton steps."""
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x, t = np.c_[margin, np.ones(len(y))], np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * np.array([t[0] - 1, t[1]]))
        t = t - np.clip(step, -5, 5)
    return float(max(t[0], 1e-3)), float(t[1])


@dataclass
class Fitted:
    """The model as its parts: scores need the squared scales to bring a text to length 1."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def parts(self) -> tuple:
        """Plain arrays and numbers, which executors can read without this package."""
        return self.weights, self.squares, self.bias, self.slope, self.shift


def text_score(parts: tuple, text: str | None) -> float:
    """The score of a text under a model's parts."""
    weights, squares, bias, slope, shift = parts
    own = indicators(text)
    margin = float(weights[own].sum()) / max(float(np.sqrt(squares[own].sum())), 1e-9) + bias
    return float(1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30))))


def fit_rows(rows: Rows, y: np.ndarray) -> Fitted:
    """Fit ratios, hinge model and curve to indicator sets and labels."""
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 1.0
        return Fitted(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 1.0, 30.0 if share == 1 else -30.0)
    every, margin = np.arange(len(y)), np.zeros(len(y))
    for f in range(FOLDS):
        train, test = every[every % FOLDS != f], every[every % FOLDS == f]
        squares = _log_ratios(rows, y, train) ** 2
        norm = _norms(rows, squares)
        margin[test] = _margins(rows, norm, *_descend(rows, y, squares, norm, train, max(EPOCHS // 3, 1)), test)
    slope, shift = _curve(margin, y)
    squares = _log_ratios(rows, y, every) ** 2
    w, b = _descend(rows, y, squares, _norms(rows, squares), every)
    return Fitted(w.astype(np.float32), squares.astype(np.float32), b, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Fitted:
    """docs: doc_id, text; labels: doc_id, quality (0 or 1)."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * most / n))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).filter("y = z").select("doc_id", "y")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [indicators(t) for t in pdf["text"]]
            packed = [zlib.compress(np.diff(r, prepend=np.int32(0)).tobytes(), 1) for r in own]  # a quarter of the size
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "n": [len(r) for r in own], "own": packed})

    # about ``most`` ids of 16 bytes are broadcast, so that the texts aren't shuffled
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInPandas(sets, "doc_id long, y int, n long, own binary"), "indicators")
    size = 4 * (rows.agg(F.sum("n")).first()[0] or 0)
    if size > most_bytes:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_003)) < int(1_000_003 * most_bytes / size))
    found = rows.toPandas().sort_values(["doc_id", "n", "own"], kind="stable").drop_duplicates("doc_id")
    y = found["y"].to_numpy(int)
    sets = Rows(found["n"], (np.cumsum(np.frombuffer(zlib.decompress(r), np.int32), dtype=np.int32) for r in found["own"]))
    del found
    return fit_rows(sets, y)


def score(docs: DataFrame, model: Fitted, text_col: str = "text") -> DataFrame:
    """Adds ``score`` and ``predicted`` (1 from 0.7 on) to all rows."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([text_score(sent.value, t) for t in s], index=s.index, dtype=float)

    out = docs.withColumn("score", F.pandas_udf(scores, "double")(F.coalesce(F.col(text_col), F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    # all columns go beside the text, under one name: whatever they are called, none is overwritten
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score(rows, fit(docs, labels)).filter("predicted = 1").select("row.*")
