"""The cells of the near-duplicate join: small ones without an open pair are passed over, none with one is."""

import numpy as np
import pandas as pd

from quillspark.llm import near_dup


def test_only_cells_that_may_hold_an_open_pair_are_compared():
    g = np.random.default_rng(5)
    rows = []
    for key in range(400):
        base = g.integers(0, 2**63, 60).astype(np.uint64)
        for rep in range(int(g.integers(1, 6)) if key % 50 else 90):
            ids = base.copy() if key % 3 == 0 else g.integers(0, 2**63, int(g.integers(20, 90))).astype(np.uint64)
            ids[: rep * 2] = g.integers(0, 2**63, len(ids[: rep * 2]))
            bins = near_dup.word_bins(ids, np.array([0, len(ids)]))[0].tobytes()
            rows.append((key, 0, 0, 0, 1000 * key + rep, 1000 * key + rep % 3, 0, 0, 0, len(ids), bins, np.array([key])))
    cells = pd.DataFrame(rows, columns=["key", "i", "j", "own", "rep", "class", "part", "x", "y", "words", "bins", "keys"])
    seen = []

    def count(pdf, least):
        seen.append(pdf["key"].iloc[0])
        return near_dup._involved(pdf, least)

    parts = [cells[i : i + 97].reset_index(drop=True) for i in range(0, len(cells), 97)]
    got = pd.concat(near_dup._by_cell(iter(parts), count, 0.8))
    want = pd.concat([near_dup._involved(own.reset_index(drop=True), 0.8) for _, own in cells.groupby("key")])
    assert len(want) > 100
    assert got.sort_values(["key", "rep", "x", "y"]).astype(int).values.tolist() == want.sort_values(["key", "rep", "x", "y"]).astype(int).values.tolist()
    assert len(seen) == len(set(seen)) < 200
