"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of 32 words, one every 16 words, over all of each text.
Words are hashed into 2**15 buckets and weighted by inverse document frequency
over all documents. A randomised SVD of TF-IDF passages gives 88 latent
dimensions: each of its passes is a Spark aggregation of partition products,
whose blocks stay with the executors; the driver sees products of columns.
It is an index's fit and uses the benchmark's passages and a hash sample of
about ``SAMPLE`` corpus passages; every passage is then indexed and compared.

A passage whose latent cosine with a benchmark item reaches ``COSINE`` (less
for items of under ``SHORT`` words) is checked in place: the longest common subsequence of the item and the words
around the passage has to cover ``COVERED`` of the item, or ``PARAPHRASED`` of
it with the item's answer present. The answer is the column ``answer`` if the
benchmark has one, else the item's five rarest words, of which four are needed.

That check can only succeed where a share ``PARAPHRASED`` of an item's words
stands around the passage. Candidates are first held against that in bulk, by
the bins of the words around them; this loses no row.
Items of fewer than five words are looked for as exact phrases (covered and
cosine are 1).

Documents are mapped in two passes without a shuffle of texts. What is sent to
the executors is the projection (2**15 x 88 floats, 12 MB) and the items, in
rounds of up to about ``ITEMS`` items and ``ITEM_CHARS`` characters.

Defined results: null and empty texts give no row, as do items without words;
repeated rows and repeated items give one row for each pair of
ids; null ids are dropped from the result; further columns don't matter; empty
tables give an empty result; long texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, release, small_batches, stored, text_words, word_hashes

BUCKETS = 2**15
WIDTH, STEP = 32, 16
RANK, EXTRA = 88, 8
SAMPLE = 20_000
COSINE = 0.45
COVERED, PARAPHRASED = 0.75, 0.5
ITEMS = 5_000
ITEM_CHARS = 2_000_000
#: Items of fewer words are looked for as exact phrases.
LEAST = 5
#: Items of fewer words fill less of a window; their cosine may be lower by the root of the share.
SHORT = 24
BINS = 2048
_SLICE = 1024
#: Rows of a matrix that travel together, 0.4 MB; and the parts that a sample is multiplied in.
_BLOCK = 2**10
_PARTS = 3
_SEED = 11


def _bucket(ids: np.ndarray) -> np.ndarray:
    return ((ids >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)


def _pieces(whole: np.ndarray) -> pd.DataFrame:
    """An array as rows of blocks, to be summed by block."""
    n = len(whole) // _BLOCK
    return pd.DataFrame({"block": np.arange(n), "part": [whole[i * _BLOCK : (i + 1) * _BLOCK].tobytes() for i in range(n)]})


def _summed(parts: DataFrame, kind: type) -> DataFrame:
    """The sums of the partitions' arrays by block."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, kind) for p in sorted(pdf["part"]))  # in one order, whichever came first
        return pd.DataFrame({"block": pdf["block"][:1], "part": [np.asarray(total, kind).tobytes()]})

    return parts.groupBy("block").applyInPandas(add, "block long, part binary")


def _sum_pieces(parts: DataFrame, kind: type) -> np.ndarray:
    """The sum of the partitions' arrays, in the driver: for vectors over the buckets."""
    rows = _summed(parts, kind).toPandas().sort_values("block")
    return np.concatenate([np.frombuffer(p, kind) for p in rows["part"]]) if len(rows) else np.zeros(0, kind)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents that hold each bucket, the number of documents and of passages."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, passages = np.zeros(BUCKETS, np.int64), 0, 0
        for pdf in batches:
            for ids, at in word_hashes(pdf["text"]):
                size = np.diff(at)
                doc = np.repeat(np.arange(len(size)), size)
                own = np.unique(doc * BUCKETS + _bucket(ids))
                df += np.bincount(own % BUCKETS, minlength=BUCKETS)
                n, passages = n + len(size), passages + int(np.ceil(size / STEP).sum())
        tail = np.zeros(_BLOCK, np.int64)
        tail[:2] = n, passages
        yield _pieces(np.r_[df, tail])

    total = _sum_pieces(docs.select("text").mapInPandas(count, "block long, part binary"), np.int64)
    return (total[:BUCKETS], int(total[BUCKETS]), int(total[BUCKETS + 1])) if len(total) else (np.zeros(BUCKETS, np.int64), 0, 0)


def _starts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where blocks of STEP words start, their texts, and which blocks begin a window with the next."""
    size = np.diff(at)
    n = np.ceil(size / STEP).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), n)
    first = np.cumsum(n) - n
    start = at[:-1][doc] + (np.arange(len(doc)) - first[doc]) * STEP
    pair = np.r_[doc[1:] == doc[:-1], False] if len(doc) else np.zeros(0, bool)
    return start, doc, pair


def _sampled(docs: DataFrame, idf: np.ndarray, share: float) -> DataFrame:
    """TF-IDF passages drawn by a hash of their words: (buckets, weights)."""
    limit = np.uint64(min(share, 1.0) * (2**64 - 2048))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ids, at in word_hashes(pdf["text"]):
                start, doc, _ = _starts(at)
                if not len(start):
                    continue
                chosen = np.add.reduceat(ids * np.uint64(0x9E3779B97F4A7C15), start) <= limit
                for s, d in zip(start[chosen], doc[chosen]):
                    own, n = np.unique(_bucket(ids[s : min(s + WIDTH, at[d + 1])]), return_counts=True)
                    w = n * idf[own]
                    out.append((own, w / max(np.linalg.norm(w), 1e-9)))
            yield pd.DataFrame({"own": pd.Series([o for o, _ in out], dtype=object), "weight": pd.Series([w for _, w in out], dtype=object)})

    return docs.select("text").mapInPandas(draw, "own array<long>, weight array<double>")


def _turned(part: bytes, turns: list[np.ndarray]) -> np.ndarray:
    """A block of a matrix, times some small matrices."""
    out = np.frombuffer(part, np.float32).reshape(-1, RANK + EXTRA)
    for turn in turns:
        out = out @ turn
    return out


def _orthonormal(z: DataFrame) -> list[np.ndarray]:
    """What z's blocks are to be multiplied by for an orthonormal base of its columns' span.

    Each matrix comes from the eigenvectors of the columns' products; twice is as good as a QR.
    """
    turns: list[np.ndarray] = []
    for _ in range(2):

        def products(batches: Iterator[pd.DataFrame], turns=tuple(turns)) -> Iterator[pd.DataFrame]:
            total = np.zeros((RANK + EXTRA, RANK + EXTRA))
            for pdf in batches:
                for part in pdf["part"]:
                    b = _turned(part, turns).astype(np.float64)
                    total += b.T @ b
            yield pd.DataFrame({"part": [total.tobytes()]})

        gram = _square(z.coalesce(_PARTS).mapInPandas(products, "part binary"))
        value, turn = np.linalg.eigh(gram)
        turns.append((turn / np.sqrt(np.maximum(value, 1e-12 * value.max() + 1e-30))).astype(np.float32))
    return turns


def _square(parts: DataFrame) -> np.ndarray:
    """The sum of at most ``_PARTS`` products of columns, 74 KB each."""
    wide = RANK + EXTRA
    return sum((np.frombuffer(p).reshape(wide, wide) for p in sorted(bytes(x["part"]) for x in parts.collect())), np.zeros((wide, wide)))


def randomised_svd(passages: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Right singular vectors, as rows (block, part) of ``_BLOCK`` buckets each, and values of sparse rows (share, own, weight), by range finding.

    Two passes find the range, a third the small covariance; each adds up the
    products of the ``_PARTS`` shares, whose size doesn't depend on the number of rows. Few
    shares suffice for a bounded sample, and keep the products few. The base of
    a pass meets the rows in a cogroup: it is neither collected nor broadcast.
    """
    wide = RANK + EXTRA

    def multiplied(own: pd.Series, weight: pd.Series, base: np.ndarray) -> pd.DataFrame:
        total = np.zeros((BUCKETS, wide), np.float32)
        for o, w in zip(own, weight):
            total[o] += np.outer(w, w @ base[o])
        return _pieces(total)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"own": [], "weight": []}, dtype=object), *batches])
        yield multiplied(rows["own"], rows["weight"], np.random.default_rng(_SEED).standard_normal((BUCKETS, wide)).astype(np.float32))

    def whole(blocks: pd.DataFrame, turns: list[np.ndarray]) -> np.ndarray:
        base = np.zeros((BUCKETS, wide), np.float32)
        for block, part in zip(blocks["block"], blocks["part"]):
            base[block * _BLOCK : (block + 1) * _BLOCK] = _turned(part, turns)
        return base

    def met(z: DataFrame, turns: list[np.ndarray], f: Callable[[pd.Series, pd.Series, np.ndarray], pd.DataFrame], kind: str) -> DataFrame:
        each = z.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))

        def together(rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
            return f(rows["own"], rows["weight"], whole(blocks, turns))

        return passages.groupBy("share").cogroup(each.groupBy("share")).applyInPandas(together, kind)

    z = stored(_summed(passages.select("own", "weight").mapInPandas(first, "block long, part binary"), np.float32), "svd")
    z = stored(_summed(met(z, _orthonormal(z), multiplied, "block long, part binary"), np.float32), "svd")
    turns = _orthonormal(z)

    def covariance(own: pd.Series, weight: pd.Series, base: np.ndarray) -> pd.DataFrame:
        total = np.zeros((wide, wide))
        for o, w in zip(own, weight):
            y = w @ base[o]
            total += np.outer(y, y)
        return pd.DataFrame({"part": [total.tobytes()]})

    value, turn = np.linalg.eigh(_square(met(z, turns, covariance, "part binary")))
    value, turn = np.maximum(value[::-1][:RANK], 1e-9), turn[:, ::-1][:, :RANK]

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(part=[_turned(p, [*turns, turn]).astype(np.float32).tobytes() for p in pdf["part"]])

    return z.coalesce(_PARTS).mapInPandas(vectors, "block long, part binary"), np.sqrt(value)


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two texts' words."""
    place: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        place[w] = place.get(w, 0) | (1 << i)
    every = (1 << len(a)) - 1
    open_ = every
    for w in b.tolist():
        own = place.get(w, 0) & open_
        if own:
            open_ = ((open_ + own) | (open_ - own)) & every
    return len(a) - open_.bit_count()


def _latent(ids: np.ndarray, start: np.ndarray, last: np.ndarray, pair: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The unit vectors of the windows that begin at the blocks; last: where the blocks end."""
    own, zero = _bucket(ids), len(base) - 1
    block = np.zeros((len(start), base.shape[1]), base.dtype)
    for i in range(STEP):
        at = start + i
        block += base[np.where(at < last, own[np.minimum(at, len(own) - 1)], zero)]
    out = block.copy()
    out[:-1][pair[:-1]] += block[1:][pair[:-1]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _item_vectors(items: list[tuple], base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the items, and of the windows of those over 40 words."""
    rows, owner = [], []
    for i, (_, ids, _) in enumerate(items):
        spans = [(0, len(ids))] + [(s, s + WIDTH) for s in range(0, len(ids) - WIDTH + 1, STEP) if len(ids) > 40]
        for s, e in spans:
            rows.append(base[_bucket(ids[s:e])].sum(0))
            owner.append(i)
    matrix = np.array(rows, np.float32).reshape(len(rows), base.shape[1])
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9), np.array(owner, np.int64)


def _bits(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of ``BINS`` bins the words of each stretch of the given size fall into, as bits."""
    seen = np.zeros((len(size), BINS), bool)
    seen[np.repeat(np.arange(len(size)), size), ((ids >> np.uint64(30)) % np.uint64(BINS)).astype(np.int64)] = True
    return np.packbits(seen, axis=1).view(np.uint64)


def _item_bits(items: list[tuple], share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bits of each item, how many of them a share of its words takes at least, and how far its words may stand apart."""
    bits = _bits(np.concatenate([np.zeros(0, np.uint64), *[own for _, own, _ in items]]), np.array([len(own) for _, own, _ in items], np.int64))
    least = []
    for _, own, _ in items:
        mass = np.sort(np.bincount(((own >> np.uint64(30)) % np.uint64(BINS)).astype(np.int64)))[::-1]
        least.append(int(np.searchsorted(np.cumsum(mass), share * len(own) - 1e-9)) + 1)
    return bits, np.array(least, np.int64), np.array([-(-len(own) // STEP) for _, own, _ in items], np.int64)


def _bits_around(bits: np.ndarray, doc: np.ndarray, far: int) -> np.ndarray:
    """The bits of each block's window and of ``far`` blocks before and after it in its text."""
    out = bits.copy()
    for d in range(1, min(far + 2, len(doc))):
        same = (doc[d:] == doc[:-d])[:, None]
        out[:-d] |= np.where(same, bits[d:], np.uint64(0))
        if d <= far:
            out[d:] |= np.where(same, bits[:-d], np.uint64(0))
    return out


def _phrase(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    out = np.zeros(max(len(ids) - n + 1, 0), np.uint64)
    for i in range(n):
        out = mix(out + ids[i : i + len(out)])
    return out


def _short(ids: np.ndarray, at: np.ndarray, phrases: dict[int, tuple]) -> set[tuple[int, int]]:
    """(text, item) of the items under ``LEAST`` words that stand whole in a text."""
    out: set = set()
    for n, (hashes, names) in phrases.items():
        found = _phrase(ids, n)
        place = np.searchsorted(hashes, found)
        hit = np.flatnonzero(hashes[np.minimum(place, len(hashes) - 1)] == found)
        text = np.searchsorted(at, hit, "right") - 1
        whole = hit + n <= at[text + 1]
        for t, k in set(zip(text[whole].tolist(), place[hit][whole].tolist())):
            out |= {(t, name) for name in names[k]}
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, covered: float = COVERED, paraphrased: float = PARAPHRASED) -> DataFrame:
    """doc_id, item_id, covered (share of the item's words in order), cosine of every leak."""
    spark = docs.sparkSession
    small_batches(spark)
    df, n, passages = document_frequency(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.05
    sample = cut(_sampled(docs, idf, SAMPLE / max(passages, 1)).unionByName(_sampled(benchmark, idf, 1.0)).repartition(_PARTS).withColumn("share", F.spark_partition_id()))
    vectors, values = randomised_svd(sample)
    base = np.zeros((BUCKETS + 1, RANK), np.float32)  # the last row: no word
    for block, part in vectors.toLocalIterator():
        at = slice(block * _BLOCK, (block + 1) * _BLOCK)
        base[at] = idf[at, None] * np.frombuffer(part, np.float32).reshape(-1, RANK) / values
    release(spark)
    m, chars = benchmark.agg(F.count("*"), F.sum(F.length("text"))).first()
    rounds = max(1, math.ceil(m / ITEMS), math.ceil((chars or 0) / ITEM_CHARS))
    has_answer = "answer" in benchmark.columns
    out = None
    for r in range(rounds):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r).select("item_id", "text", *["answer"] * has_answer).filter("item_id is not null").collect()
        items: list = []
        phrases: dict[int, dict] = {}
        for row, ids in zip(rows, text_words([x["text"] for x in rows])):
            if len(ids) >= LEAST:
                if has_answer and row["answer"]:
                    key = next(text_words([row["answer"]]))
                else:
                    own = np.unique(ids)
                    key = own[np.argsort(-idf[_bucket(own)], kind="stable")][:5]
                items.append((row["item_id"], ids, key))
            elif len(ids):
                phrases.setdefault(len(ids), {}).setdefault(int(_phrase(ids, len(ids))[0]), set()).add(row["item_id"])
        short = {k: (np.array(sorted(own), np.uint64), [sorted(own[h]) for h in sorted(own)]) for k, own in phrases.items()}
        sent = spark.sparkContext.broadcast((items, short, _item_bits(items, paraphrased), base, *_item_vectors(items, base)))
        found = docs.select("doc_id", "text").mapInPandas(lambda it, sent=sent: _search(it, sent, cosine, covered, paraphrased), "doc_id long, item_id long, covered double, cosine double")
        out = found if out is None else out.unionByName(found)
    return out.filter("doc_id is not null").groupBy("doc_id", "item_id").agg(F.round(F.max("covered"), 6).alias("covered"), F.round(F.max("cosine"), 3).alias("cosine"))


def _search(batches: Iterator[pd.DataFrame], sent, cosine: float, covered: float, paraphrased: float) -> Iterator[pd.DataFrame]:
    items, short, (item_bits, least, far), base, vectors, owner = sent.value
    counts = [dict(zip(*(x.tolist() for x in np.unique(own, return_counts=True)))) for _, own, _ in items]
    wide = far[owner]
    floor = cosine * np.minimum(1, np.sqrt([len(items[i][1]) / SHORT for i in owner]))
    for pdf in batches:
        out, offset, names = [], 0, pdf["doc_id"].tolist()
        for ids, at in word_hashes(pdf["text"]):
            start, doc, pair = _starts(at)
            if len(start) and len(owner):
                latent = _latent(ids, start, np.minimum(start + STEP, at[doc + 1]), pair, base)
                bits = _bits(ids, np.diff(np.r_[start, len(ids)]))
                for blocks in np.unique(wide):
                    seen, own_size = _bits_around(bits, doc, int(blocks)), np.flatnonzero(wide == blocks)
                    for first in range(0, len(own_size), _SLICE):
                        v = own_size[first : first + _SLICE]
                        near = latent @ vectors[v].T
                        w, k = np.nonzero(near >= floor[v])
                        item = owner[v[k]]
                        enough = np.bitwise_count(seen[w] & item_bits[item]).sum(1, dtype=np.int64) >= least[item]
                        for w, k, i in zip(w[enough], k[enough], item[enough]):
                            name, own, key = items[i]
                            d, s = doc[w], start[w]
                            around = ids[max(at[d], s - len(own)) : min(at[d + 1], s + WIDTH + len(own))]
                            count = counts[i]
                            if sum(count[x] for x in count.keys() & around.tolist()) < paraphrased * len(own):
                                continue  # too few of the item's words stand here in any order
                            share = common_words(own, around) / len(own)
                            if share >= covered or (share >= paraphrased and np.isin(key, around).sum() >= max(len(key) - 1, 1)):
                                out.append((names[offset + d], name, share, float(near[w, k])))
            out += [(names[offset + d], name, 1.0, 1.0) for d, name in _short(ids, at, short)]
            offset += len(at) - 1
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "covered", "cosine"])


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any leak, with all their columns."""
    leaks = find_leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)
