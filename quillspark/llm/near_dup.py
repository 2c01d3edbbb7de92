"""MinHash near-duplicates by Order MinHash, verified by banded alignment.

Texts become word k-mers labelled by their occurrence number. Each permutation
picks the two smallest labelled k-mers and keeps them in text order, so that a
key is shared with a probability that follows the edit similarity. There are 16
keys of five-word k-mers and 64 of three-word ones. Texts that share a key meet
in a bucket; of buckets with equal members one is kept.

For ``rounds`` rounds a bucket compares its members with its smallest member
only, and members that the alignment rejects meet again without that pivot;
this joins most of a group of copies with few comparisons. Then the members,
linked or not, of each bucket that still holds two classes are dealt into
blocks of bounded size, and a task compares two blocks: pairs of two classes
within a bound that loses none (the overlap of the texts' word counts, held in
``BINS`` bytes) are aligned, and a link makes one class of two at once. So no
bucket is capped, no link through a third text is lost, and a task returns no
pairs but the links that join classes. This work grows with the square of a
bucket where texts that share one passage are all different.

What this finds: texts that share a share J of their labelled k-mers share a
key with probability about J**2, and every link between texts that share a key
is found. Texts with 0.8 of their five-word k-mers in common share one of the
16 keys with probability 1 - 8e-8. An edit spoils at most three 3-mers, so J
is at least 0.25 at edit similarity 0.8 (every fifth word changed) and about
0.34 if the changes fall at random: one of 64 keys is shared with probability
0.98 and 0.9996. Texts of up to ``SHORT`` words get keys of 2-mers besides, as
changes in them may leave no 3-mer.

Two texts are linked if ``1 - word edits / words of the longer`` reaches
``similarity`` (0.8). Classes are the connected components of the links.

Defined results: null and wordless texts have only their exact copies
(wordless ones) or nothing (null) in their class; texts of under five words
are linked to copies that differ in case and punctuation only; repeated rows
are kept, one output row each; a null id gets a null class; an empty table
gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mix, release, small_batches, stored, text_words, word_hashes

#: Words of a k-mer, and keys made of such k-mers.
SHINGLES = ((5, 16), (3, 64))
SHORT, SHORT_SHINGLES = 40, ((2, 80),)
SIMILARITY = 0.8
ROUNDS = 2
BINS = 256
#: Members and words of a block, about.
BLOCK, BLOCK_WORDS = 4000, 2_000_000
#: Open pairs of a cell's part, about.
PART = 2000
#: Members of a cell that is judged beside others.
_SMALL = 64
_CELL = ["key", "i", "j", "x", "y"]
_SEED = 20_240_501


def order_minhash(ids: np.ndarray, at: np.ndarray, k: int, tuples: int) -> np.ndarray:
    """The keys of many texts, a row for each text that has words.

    ids: the word hashes of all texts; at: where each text's words start. A
    text of fewer than k words counts as one gram.
    """
    at = np.r_[at[:-1][np.diff(at) > 0], at[-1]]
    if len(at) == 1:
        return np.zeros((0, tuples), np.int64)
    long = np.r_[ids, np.zeros(k, np.uint64)]
    size = np.diff(at)
    doc = np.repeat(np.arange(len(size)), size)
    left = at[1:][doc] - np.arange(len(ids))  # words from here to the text's end
    grams = np.zeros(len(ids), np.uint64)
    for i in range(k):
        grams = grams * np.uint64(0x100000001B3) + np.where(left > i, long[i : i + len(ids)], np.uint64(i))
    keep = (left >= k) | (np.arange(len(ids)) == at[doc])
    grams, doc = mix(grams[keep]), doc[keep]
    start = np.searchsorted(doc, np.arange(len(size)))
    count = np.diff(np.r_[start, len(doc)])
    own = mix(grams + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(own, kind="stable")
    run = own[by]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    seen = np.empty(len(grams), np.uint64)
    seen[by] = np.arange(len(grams)) - np.repeat(first, np.diff(np.r_[first, len(grams)]))
    labelled = mix(grams + seen * np.uint64(0xA24BAED4963EE407)) | np.uint64(1 << 63)
    keys = np.empty((len(size), tuples), np.uint64)
    most = np.uint64(2**64 - 1)
    for i, odd in enumerate(np.random.default_rng(_SEED).integers(1, 2**63, tuples, np.uint64) * np.uint64(2) + np.uint64(1)):
        order = labelled * odd
        one = _first(order, start, count)
        order[one] = most
        two = np.where(count > 1, _first(order, start, count), one)
        a, b = labelled[np.minimum(one, two)], labelled[np.maximum(one, two)]
        keys[:, i] = mix(a * np.uint64(3) + mix(b + np.uint64(i + 1000 * k)))
    return keys.view(np.int64)


def text_keys(ids: np.ndarray, at: np.ndarray, shingles: tuple = SHINGLES, short: tuple = SHORT_SHINGLES) -> list[np.ndarray]:
    """The keys of each text, with those of short texts' smaller k-mers; none without words."""
    size = np.diff(at)
    few = size <= SHORT
    rows = zip(*[order_minhash(ids, at, k, n) for k, n in shingles])
    more = zip(*[order_minhash(ids[np.repeat(few, size)], np.r_[0, np.cumsum(size[few])], k, n) for k, n in short])
    out = [np.concatenate(next(rows)) if n else np.zeros(0, np.int64) for n in size]
    return [np.concatenate([own, *next(more)]) if short and f and n else own for own, f, n in zip(out, few, size)]


def _first(order: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Where the smallest value of each stretch stands first."""
    hit = np.flatnonzero(order == np.repeat(np.minimum.reduceat(order, start), count))
    return hit[np.searchsorted(hit, start)]


def word_bins(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many words of each text fall into each of ``BINS`` bins, 255 at most."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    own = doc * BINS + ((ids >> np.uint64(24)) % np.uint64(BINS)).astype(np.int64)
    return np.minimum(np.bincount(own, minlength=n * BINS), 255).astype(np.uint8).reshape(n, BINS)


def _run(a: bytes, b: bytes, i: int, j: int) -> int:
    """How many 8-byte words from word i of a and word j of b on are equal."""
    most, n, step = min(len(a) // 8 - i, len(b) // 8 - j), 0, 8
    while n < most:
        m = min(step, most - n)
        if a[8 * (i + n) : 8 * (i + n + m)] == b[8 * (j + n) : 8 * (j + n + m)]:
            n, step = n + m, step * 2
        else:  # the run ends among these words
            most, step = n + m - 1, max(m // 2, 1)
    return n


def few_edits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edits between two texts, None if over ``most``; cheap if most is small.

    Furthest-reaching alignment over the diagonals that ``most`` edits reach.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    x, y, goal = a.tobytes(), b.tobytes(), m - n
    reach = {0: _run(x, y, 0, 0)}
    if goal == 0 and reach[0] >= n:
        return 0
    for e in range(1, most + 1):
        now = {}
        for d in range(-e, e + 1):
            if abs(goal - d) > most - e:  # can't come back to the end in time
                continue
            i = max(reach.get(d, -2) + 1, reach.get(d + 1, -2) + 1, reach.get(d - 1, -2))
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            now[d] = i + _run(x, y, i, i + d)
            if d == goal and now[d] >= n:
                return e
        reach = now
    return None


def banded_edits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edits between two texts, None if over ``most``.

    The alignment table's band of 2 * most + 2 diagonals, a column at a time,
    with the column's vertical steps held as the bits of two integers.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    if most >= min(n, m):
        return few_edits(a, b, most)
    wide = 2 * most + 2
    every = (1 << wide) - 1
    place: dict[int, int] = {}  # the positions of each word of a
    for i, w in enumerate(a.tolist()):
        place[w] = place.get(w, 0) | (1 << i)
    up, down = (every >> (wide - most - 1)) << (wide - most - 1), 0
    edge, at, now = 1 << (wide - 1), most + 1 - wide, most
    for i, w in enumerate(b.tolist()):
        own = place.get(w, 0)
        own = (own >> at if at >= 0 else own << -at) & every
        diagonal = ((((own & up) + up) & every) ^ up) | own | down
        right, left = down | (every & ~(diagonal | up)), diagonal & up
        if i < n - most:  # down the diagonal to the last word of a
            now += not diagonal & edge
            if i == n - most - 1:
                edge >>= 1
        else:  # and along it
            now += bool(right & edge) - bool(left & edge)
            edge >>= 1
        down, up = (diagonal >> 1) & right, left | (every & ~((diagonal >> 1) | right))
        at += 1
        if now > (most + m - 1 - i if i >= n - most else 3 * most):
            return None
    return now if now <= most else None


def _pairs_of_words(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of neighbouring words of a text and how often each stands there."""
    return np.unique(mix(a[:-1] * np.uint64(3) + a[1:]), return_counts=True)


def _few_in_common(a: tuple, b: tuple, longer: int, most: int) -> bool:
    """Whether two texts share fewer pairs of words than ``most`` edits leave, each of which spoils two."""
    _, i, j = np.intersect1d(a[0], b[0], True, True)
    return np.minimum(a[1][i], b[1][j]).sum() < longer - 1 - 2 * most


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY, pairs: tuple | None = None) -> bool:
    """Whether the edit similarity of two texts' word hashes is ``least`` or more; pairs: of their words, if known."""
    longer = max(len(a), len(b))
    if not longer:
        return False
    most = int(longer * (1 - least) + 1e-9)
    if pairs is None and few_edits(a, b, min(most, 8)) is not None:
        return True
    if _few_in_common(*(pairs or (_pairs_of_words(a), _pairs_of_words(b))), longer, most):
        return False
    return banded_edits(a, b, most) is not None


def _verify(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pairs = zip(text_words(pdf["pivot_text"]), text_words(pdf["text"]))
        yield pd.DataFrame({"rep": pdf["rep"], "pivot": pdf["pivot"], "keys": pdf["keys"], "linked": [similar(a, b, least) for a, b in pairs]})


def _earlier(keys: pd.Series, key: int) -> tuple[np.ndarray, list[int]]:
    """For each member, the bits of those keys before this one that it shares with others of the cell: the 64 most frequent, and all."""
    own = [ks[ks < key] for ks in map(np.asarray, keys)]
    every, n = np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True)
    shared = every[n > 1][np.argsort(-n[n > 1], kind="stable")]
    bit = dict(zip(shared.tolist(), range(len(shared))))
    whole = [sum(1 << bit[k] for k in ks.tolist() if k in bit) for ks in own]
    return np.array([m & (2**64 - 1) for m in whole], np.uint64), whole


def _open_pairs(pdf: pd.DataFrame, kind: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """The pairs of a cell's members within the bound that are of two kinds when their turn comes.

    A pair is left to the first of the keys that it shares.
    """
    own, part, words = pdf["own"].to_numpy(), pdf["part"].to_numpy(), pdf["words"].to_numpy().astype(np.int64)
    inner, whole = pdf["i"].iloc[0] == pdf["j"].iloc[0], pdf["x"].iloc[0] == pdf["y"].iloc[0]
    first, earlier = _earlier(pdf["keys"], pdf["key"].iloc[0])
    bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(-1, BINS).astype(np.int16)
    for d in range(1, len(pdf)):
        longer = np.maximum(words[:-d], words[d:])
        most = np.floor(longer * (1 - least) + 1e-9).astype(np.int64)
        may = (kind[:-d] != kind[d:]) & (inner | (own[:-d] != own[d:])) & (whole | (part[:-d] != part[d:])) & (np.abs(words[:-d] - words[d:]) <= most) & (first[:-d] & first[d:] == 0)
        at = np.flatnonzero(may)
        for at in np.array_split(at, len(at) // 4096 + 1):
            apart = np.abs(bins[at] - bins[at + d]).sum(1, dtype=np.int64)
            for a in at[words[at] + words[at + d] - apart >= 2 * (longer[at] - most[at])].tolist():
                if kind[a] != kind[a + d] and not earlier[a] & earlier[a + d]:
                    yield a, a + d
        if (kind == kind[0]).all():
            break


def _involved(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """The members of a cell that stand in an open pair, dealt into parts of which a task compares two."""
    hit, n = np.zeros(len(pdf), bool), 0
    for a, b in _open_pairs(pdf, pdf["class"].to_numpy(), least):
        hit[a] = hit[b] = True
        n += 1
    found = pdf.loc[hit, [*_CELL[:3], "own", "rep", "class"]]
    parts = int(np.ceil(np.sqrt(max(n, 1) / PART)))
    part = np.arange(len(found)) % parts
    return pd.concat([found.assign(part=part, x=np.minimum(part, p), y=np.maximum(part, p)) for p in range(parts)])


def _cell_links(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links that join the classes of a cell's members, found by aligning the open pairs."""
    kind, rep = np.unique(pdf["class"], return_inverse=True)[1], pdf["rep"].to_numpy()
    texts = list(text_words(pdf["text"]))
    pairs = [_pairs_of_words(t) for t in texts]
    found = []
    for a, b in _open_pairs(pdf, kind, least):
        if similar(texts[a], texts[b], least, (pairs[a], pairs[b])):
            kind[kind == kind[a]] = kind[b]
            found.append((rep[a], rep[b]))
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def _hopeful(pdf: pd.DataFrame, size: np.ndarray, least: float) -> np.ndarray:
    """Which of the cells, of the given sizes one after another, hold members of two classes within the bound; larger cells count as such.

    All cells of a batch at once: most are small and hold no such pair.
    """
    hit = size > _SMALL
    cell, rows = np.repeat(np.arange(len(size)), size), int(size.sum())
    kind, words = pdf["class"].to_numpy()[:rows], pdf["words"].to_numpy()[:rows].astype(np.int64)
    bins = np.frombuffer(b"".join(pdf["bins"][:rows]), np.uint8).reshape(-1, BINS).astype(np.int16)
    for d in range(1, min(size.max(initial=0), _SMALL)):
        longer = np.maximum(words[:-d], words[d:])
        most = np.floor(longer * (1 - least) + 1e-9).astype(np.int64)
        at = np.flatnonzero((cell[:-d] == cell[d:]) & ~hit[cell[:-d]] & (kind[:-d] != kind[d:]) & (np.abs(words[:-d] - words[d:]) <= most))
        apart = np.abs(bins[at] - bins[at + d]).sum(1, dtype=np.int64)
        hit[cell[at[words[at] + words[at + d] - apart >= 2 * (longer[at] - most[at])]]] = True
    return hit


def _by_cell(batches: Iterator[pd.DataFrame], f: Callable[[pd.DataFrame, float], pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """f of each cell that may hold an open pair; a cell's rows stand together and may go on in the next batch."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        cell = pdf[_CELL].to_numpy()
        cuts = np.r_[0, np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1]
        for i in np.flatnonzero(_hopeful(pdf, np.diff(cuts), least)):
            yield f(pdf[cuts[i] : cuts[i + 1]].reset_index(drop=True), least)
        rest = pdf[cuts[-1] :]
    if rest is not None and _hopeful(rest, np.array([len(rest)]), least)[0]:
        yield f(rest.reset_index(drop=True), least)


def cell_links(members: DataFrame, sizes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): links between the classes of the members (key, rep, class) of a key; sizes: rep, words, bins; texts: id, text.

    The first pass over the cells, without texts, finds the members that stand
    in an open pair, so that only their texts are sent to the second.
    """
    sized = members.join(sizes.select("rep", "words"), "rep")
    open_ = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("words").alias("w"), F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("w") / BLOCK_WORDS)).cast("long")
    dealt = stored(members.join(open_.select("key", blocks.alias("blocks")), "key"), "open")
    keys = dealt.groupBy("rep").agg(F.collect_list("key").alias("keys"))  # as many as a text has at most
    each = stored(keys.join(sizes, "rep"), "open")
    cells = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "class")

    def together(df: DataFrame) -> DataFrame:
        return df.repartition(*_CELL).sortWithinPartitions(*_CELL, "rep")

    cells = cells.select("*", *[F.lit(0).cast("long").alias(c) for c in ("part", "x", "y")])
    kind = ", ".join(f"{c} long" for c in (*_CELL[:3], "own", "rep", "class", "part", "x", "y"))
    met = stored(together(cells.join(each, "rep")).mapInPandas(lambda it: _by_cell(it, _involved, least), kind), "met")
    whole = met.join(each, "rep").join(texts.withColumnRenamed("id", "rep"), "rep")
    return together(whole).mapInPandas(lambda it: _by_cell(it, _cell_links, least), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, class): the smallest node that each node of (a, b) links reaches.

    Smallest-neighbour steps with pointer jumps; each step is a join and an
    aggregation of the links, cut by a checkpoint.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    now = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("class")))
    while True:
        near = both.join(now.withColumnsRenamed({"node": "b", "class": "c"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = now.join(near, "node").select("node", F.least("class", "c").alias("next"), F.col("class").alias("was"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        step = cut(step.join(jump, "next", "left").select("node", F.coalesce("far", "next").alias("class"), "was"))
        moved = step.filter("class <> was").limit(1).count()
        now = step.select("node", "class")
        if not moved:
            return now


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingles: tuple = SHINGLES, short: tuple = SHORT_SHINGLES, rounds: int = ROUNDS
) -> DataFrame:
    """One row per document: its id and ``class_id``, the smallest id of its class."""
    spark = docs.sparkSession
    small_batches(spark)

    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            keys: list = []
            words: list = []
            bins: list = []
            for ids, at in word_hashes(s):
                keys += text_keys(ids, at, shingles, short)
                words += np.diff(at).tolist()
                bins += [b.tobytes() for b in word_bins(ids, at)]
            yield pd.DataFrame({"keys": pd.Series(keys, dtype=object), "words": words, "bins": bins})

    kind = T.StructType().add("keys", T.ArrayType(T.LongType())).add("words", T.IntegerType()).add("bins", T.BinaryType())
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = stored(
        docs.select("id", F.unhex(F.md5("text")).alias("copy"), F.pandas_udf(sketch, kind)("text").alias("s")).select("id", "copy", "s.*"), "sketches"
    )
    # one representative per exact text; the hot groups of copies shrink before the shuffle
    reps = stored(sketched.filter("copy is not null and id is not null").groupBy("copy").agg(F.min("id").alias("rep")), "texts")
    own = sketched.join(reps.select(F.col("rep").alias("id"), "copy"), ["id", "copy"], "left_semi").withColumnRenamed("id", "rep")
    # dealt by key once, for the keys of two texts or more and for their members
    keyed = own.select("rep", F.explode("keys").alias("key")).repartition("key")
    shared = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("key")
    members = stored(keyed.join(shared, "key").distinct(), "members")
    # of keys with the same members one is enough
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("pivot"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("s"))
    kept = buckets.filter("n > 1").groupBy("pivot", "n", "s").agg(F.min("key").alias("key")).select("key")
    members = stored(members.join(kept, "key"), "members")
    known = reps.select("rep", F.col("rep").alias("class"))
    if members.limit(1).count():
        need = members.select("rep").distinct()
        sizes = stored(own.join(need, "rep", "left_semi").groupBy("rep").agg(F.first("words").alias("words"), F.first("bins").alias("bins")), "sizes")
        texts = stored(docs.join(need.withColumnRenamed("rep", "id"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "candidates")
        release(spark)  # this stage alone runs hundreds of jobs
        links = _pivot_links(members, texts, similarity, rounds)
        release(spark)
        for _ in range(2):
            known = stored(_contracted(known, links), "classes")
        # linked members too: they may be the only link of others to the class
        rest = stored(cell_links(members.join(known, "rep"), sizes, texts, similarity), "links")
        release(spark)
        joined = components(_between(known, links.union(rest))).select(F.col("node").alias("class"), F.col("class").alias("low"))
        known = known.join(joined, "class", "left").select("rep", F.coalesce("low", "class").alias("class"))
    classes = reps.join(known, "rep").select("copy", F.col("class").alias("class_id"))
    return (
        sketched.select("id", "copy").join(classes, "copy", "left")
        .select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"))
    )


def _between(known: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): the distinct links between classes of (rep, class), the larger one first."""
    low, high = (known.select(F.col("rep").alias(end), F.col("class").alias(f"c{end}")) for end in ("a", "b"))
    ends = links.join(low, "a").join(high, "b").filter("ca <> cb")
    return ends.select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct()


def _contracted(known: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, class) after each class went to the smallest one that it is linked to, and once more: never too wide."""
    down = _between(known, links).groupBy(F.col("a").alias("class")).agg(F.min("b").alias("b"))
    for _ in range(2):
        known = known.join(down, "class", "left").select("rep", F.coalesce("b", "class").alias("class"))
    return known


def _pivot_links(members: DataFrame, texts: DataFrame, similarity: float, rounds: int) -> DataFrame:
    """(a, b): links of members (key, rep) to the smallest open member of their key, for some rounds."""
    open_, links = members, []
    for again in range(rounds):
        # partial minima come before the shuffle
        pivots = open_.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).filter("n > 1").drop("n")
        # a text meets a pivot once, with the keys that they share; dealt by the text, so that no task aligns all texts of a pivot
        met = open_.join(pivots, "key").filter("rep <> pivot").groupBy("rep", "pivot").agg(F.collect_list("key").alias("keys"))
        pairs = met.join(texts.withColumnsRenamed({"id": "pivot", "text": "pivot_text"}), "pivot").join(texts.withColumnRenamed("id", "rep"), "rep")
        judged = pairs.mapInPandas(lambda it: _verify(it, similarity), "rep long, pivot long, keys array<long>, linked boolean")
        if again + 1 < rounds:  # open stays who was no pivot and was not linked to it
            judged = judged.select("rep", "pivot", "linked", F.explode_outer(F.expr("if(linked, null, keys)")).alias("key"))
            judged = stored(judged, "links")
            open_ = judged.filter("not linked").select("key", "rep")
        else:
            judged = stored(judged.drop("keys"), "links")
        links.append(judged.filter("linked").select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
    return reduce(DataFrame.union, links)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keep the document of each class that has the smallest id, with all its columns.

    Rows that are equal in all columns count as one document; rows without an
    id stay.
    """
    classes = near_duplicates(docs)
    gone = classes.filter("doc_id <> class_id").select("doc_id").distinct()
    twice = classes.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id").join(gone, "doc_id", "left_anti")
    once = docs.join(gone.union(twice), "doc_id", "left_anti")
    return once.unionByName(docs.join(twice, "doc_id", "left_semi").dropDuplicates()).select(*docs.columns)
