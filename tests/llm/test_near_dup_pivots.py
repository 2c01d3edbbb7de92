"""The pivot rounds: a text meets each pivot once, and its keys come back from the comparison, not from a join of all keys with all pairs."""

import random
from collections import defaultdict

from quillspark.llm import near_dup
from quillspark.llm.common import text_words


def test_keys_travel_with_their_pair(spark, monkeypatch):
    r = random.Random(3)
    base = [" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(6)]
    texts = {i: base[i % 6] + f" end{i}" for i in range(48)}  # groups of copies, all of which share keys
    members = {(key, i) for key in range(25) for i in texts if r.random() < 0.7}
    words = dict(zip(texts, text_words(texts.values())))
    want, open_ = [], members
    for _ in range(2):
        by = defaultdict(list)
        for key, i in open_:
            by[key].append(i)
        pairs = {(i, min(own)) for own in by.values() for i in own if i != min(own)}
        linked = {(a, b) for a, b in pairs if near_dup.similar(words[a], words[b])}
        want += linked
        open_ = {(key, i) for key, own in by.items() for i in own if i != min(own) and (i, min(own)) not in linked}
    plans = []

    def stored(df, name, real=near_dup.stored):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(near_dup, "stored", stored)
    links = near_dup._pivot_links(
        spark.createDataFrame(sorted(members), "key long, rep long"), spark.createDataFrame(list(texts.items()), "id long, text string"), 0.8, 2
    )
    assert sorted(map(tuple, links.collect())) == sorted(want) and len(want) > 20
    assert len(plans) == 2 and not any("LeftSemi" in p for p in plans)
