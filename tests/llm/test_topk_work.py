"""The work of the exact search: a level's segments are added at once, in numbers that hold the scores."""

import time

import numpy as np
import pytest

from quillspark.llm import exact_topk


def block(n: int, width: int, size: float):
    ids = np.arange(n)
    return ids, np.floor(size * np.random.default_rng(3).standard_normal((n, width)))


def test_a_search_takes_less_than_adding_its_segments_one_at_a_time():
    ids, x = block(16384, 64, 32)
    index, q = exact_topk.segments(0, ids, x), x[:512]
    began = time.thread_time()
    exact_topk.best(ids[:512], q, index, 5)
    took, began = time.thread_time() - began, time.thread_time()
    for first in range(0, len(q), 64):
        score, weight = np.zeros((len(x), 64)), np.ascontiguousarray(q[first : first + 64].T)
        for dim, rows, values in zip(index["dim"], index["rows"], index["values"]):
            if dim >= 0:
                score[rows] += np.asarray(values)[:, None] * weight[dim]
    assert took < time.thread_time() - began, took


@pytest.mark.parametrize("size", [1, 32, 60, 3000, 1e9, 1e80, 1e200])
def test_scores_of_any_size_are_exact(size):
    """In single precision, in doubles, and with Python's integers."""
    ids, x = block(700, 16, size)
    x[5], x[6], x[7] = 0, x[8], 1000 * x[9]
    found = exact_topk.best(ids[:60], x[:60], exact_topk.segments(0, ids, x), 5)
    for i in range(60):
        score = [sum(int(a) * int(b) for a, b in zip(x[i], y)) for y in x]
        score = [max(min(s, 2**63 - 1), -(2**63)) for s in score]
        want = sorted((-s, j) for j, s in enumerate(score) if j != i)[:5]
        own = found[found["query_id"] == i]
        assert [(-s, j) for s, j in zip(own["score"].tolist(), own["vec_id"].tolist())] == want
