"""Prefix trie of conversations by whole-sequence collapse.

``rebuilt`` gives every conversation the head of its group's first one and keeps
its own turns behind that. ``trie`` then groups identical conversations into
weighted sequences with the digest of the list of their ids, so that a thousand
copies cost as much as one from there on. Sequences that are a proper prefix of
another fall out by an anti-join; what is left are the leaves. The prefixes of
the weighted sequences, aggregated, are the trie's nodes.

A prefix is known by its depth and two 64-bit sums (exclusive or) of hashes of
depth, role and text. Such sums run over blocks of turns, so that a conversation
of any length is spread over tasks; positions come from a range sort that also
splits one. A node belongs to the sequence of its smallest member, of which it
is the only prefix of its depth: what nodes owe to the ones above is summed
along these sequences, by a join on unique keys. Only the digest of a list of
ids reads one group of copies in order, as a stream of ids with one running hash.

Defined results: rows without a conversation id take no part; null roles and
texts are empty; null turns come first, rows with the same turn stand in the
order of role and text, repeated rows are turns of their own; an empty table has
no node, not even a root; further columns don't matter; texts of any length are
hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Conversations in a group, and one more than the most turns that are taken from its first one.
GROUP, HEADS = 20, 4
#: Turns in a block of running sums.
BLOCK = 512
EMPTY = hashlib.sha256().hexdigest()
_WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["depth", "a", "b"]


def _placed(turns: DataFrame) -> DataFrame:
    """p, conv_id, place (from 0), ha, hb, words: turns in order, numbered by a range sort of all of them."""
    own = turns.filter("conv_id is not null").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    order = ["conv_id", "turn", "role", "text"]
    rows = own.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("p"), "conv_id", F.monotonically_increasing_id().alias("m"),
        F.xxhash64("role", "text").alias("ha"), F.xxhash64(F.lit("b"), "text", "role").alias("hb"), F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"),
    )
    rows = stored(rows, "turns")
    parts = rows.groupBy("p", "conv_id").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    order = Window.partitionBy("conv_id").orderBy("p")  # one row a partition that holds some of a conversation
    parts = parts.withColumn("before", F.sum("n").over(order) - F.col("n")).drop("n")
    return rows.join(parts, ["p", "conv_id"]).select("p", "conv_id", (F.col("m") - F.col("first") + F.col("before")).alias("place"), "ha", "hb", "words")


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """conv_id, depth (from 1), ha, hb, words of all rebuilt turns, and a row of depth 0 for each conversation.

    A conversation takes as many turns of its group's first one as the CRC-32
    of its decimal id modulo ``heads`` says, and drops as many of its own.
    """
    placed = stored(_placed(turns), "placed")
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("donor"))
    convs = convs.join(sizes.withColumnRenamed("conv_id", "donor"), "donor", "left").withColumn("k", F.least("h", F.coalesce("n", F.lit(0))))
    hashes = ["ha", "hb", "words"]
    # what a conversation keeps needs its k: by partition and id, so that no long conversation meets in one task
    spread = placed.select("p", "conv_id").distinct().join(convs.select("conv_id", "h", "k"), "conv_id")
    kept = placed.join(spread, ["p", "conv_id"]).filter("place >= h").select("conv_id", (F.col("k") + F.col("place") - F.col("h") + 1).alias("depth"), *hashes)
    first = placed.filter(F.col("place") < heads - 1).select(F.col("conv_id").alias("donor"), "place", *hashes)
    given = convs.filter("k > 0").join(first, "donor").filter("place < k").select("conv_id", (F.col("place") + 1).alias("depth"), *hashes)
    zero = F.lit(0).cast("long")
    return kept.unionByName(given).unionByName(convs.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in hashes]))


def _marks() -> list[Column]:
    """The two hashes of a turn at its depth; the textless root has none."""
    mark = lambda c: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("depth", c))
    return [mark("ha").alias("a"), mark("hb").alias("b")]


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal (n, a, b): the first id, how many there are, and the digest of all."""
    now, first, weight, digest = None, None, 0, None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
        ids = batch.column(3).to_pylist()
        starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(ids)] if ids else [0]
        out = []
        for i, j in zip(starts[:-1], starts[1:]):
            key, text = tuple(keys[i].tolist()), ",".join(map(str, ids[i:j]))
            if key == now:
                digest.update(("," + text).encode())
                weight += int(j - i)
                continue
            if now is not None:
                out.append((*now, first, weight, digest.hexdigest()))
            now, first, weight, digest = key, ids[i], int(j - i), hashlib.sha256(text.encode())
        yield _batch(out)
    if now is not None:
        yield _batch([(*now, first, weight, digest.hexdigest())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["n", "a", "b", "rep", "weight", "ends_sha256"])


def sequences(rows: DataFrame) -> DataFrame:
    """n, a, b, rep, weight, ends_sha256: each different conversation once.

    rep is the smallest id, weight how many conversations are the same, and the
    digest that of their ids in ascending order.
    """
    whole = rows.select("conv_id", "depth", *_marks()).groupBy("conv_id").agg(F.max("depth").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    order = ["n", "a", "b"]
    return whole.select(*order, "conv_id").repartition(*order).sortWithinPartitions(*order, "conv_id").mapInArrow(_collapsed, "n long, a long, b long, rep long, weight long, ends_sha256 string")


def _running(rows: DataFrame, columns: dict[str, str], total, down: bool = False) -> DataFrame:
    """Replaces columns by their running totals along (rep, depth), from the top or from the end.

    Blocks are summed first, then the totals of the blocks before a block go to
    its rows: a window holds one block.
    """
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    turn = F.desc if down else F.asc
    ahead = Window.partitionBy("rep").orderBy(turn("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    sums = rows.groupBy("rep", "block").agg(*[total(c).alias(c) for c in columns])
    sums = sums.select("rep", "block", *[total(c).over(ahead).alias(f"{c}_ahead") for c in columns]).filter(" or ".join(f"{c}_ahead is not null" for c in columns))
    own = Window.partitionBy("rep", "block").orderBy(turn("depth"))
    add = (lambda x, y: x.bitwiseXOR(y)) if total is F.bit_xor else (lambda x, y: x + y)
    out = rows.join(sums, ["rep", "block"], "left")
    return out.withColumns({name: add(total(c).over(own), F.coalesce(f"{c}_ahead", F.lit(0))) for c, name in columns.items()}).drop("block", *[f"{c}_ahead" for c in columns])


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of conversations given as conv_id, depth, ha, hb, words with a row of depth 0 each.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (words that copies of shared turns repeat, over the
    subtree), ends_sha256 (digest of the ids that end here).
    """
    seqs = stored(sequences(rows), "sequences")
    own = rows.withColumnRenamed("conv_id", "rep").join(seqs.select("rep", "n", "weight"), "rep").select("rep", "n", "weight", "depth", "words", *[m.alias(f"own_{c}") for m, c in zip(_marks(), "ab")])
    prefixes = _running(own, {"own_a": "a", "own_b": "b"}, F.bit_xor)
    above = {f"up_{c}": F.col(c).bitwiseXOR(F.col(f"own_{c}")) for c in "ab"}
    prefixes = stored(prefixes.withColumns(above).drop("own_a", "own_b"), "prefixes")

    inner = prefixes.filter("depth < n").select(*_KEY).distinct()
    leaves = seqs.withColumn("depth", F.col("n")).join(inner, _KEY, "left_anti").select("rep", F.lit(1).alias("leaf"))
    nodes = prefixes.join(leaves, "rep", "left").groupBy(*_KEY).agg(
        F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"), F.max("words").alias("words"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b")
    )
    nodes = stored(nodes, "nodes")

    owed = nodes.select(F.col("conv_id").alias("rep"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    below = prefixes.select("rep", *_KEY).join(owed, ["rep", "depth"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    saved = _running(below, {"own": "owing"}, F.sum, down=True).groupBy(*_KEY).agg(F.sum("owing").alias("saved_tokens"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")]
    children = nodes.filter("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    ends = seqs.select(F.col("n").alias("depth"), "a", "b", "ends_sha256")
    named = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(saved, _KEY).join(children, _KEY, "left").join(ends, _KEY, "left").join(named, ["depth", "up_a", "up_b"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


def oracle() -> str:
    """DuckDB SQL of the query: conversations as lists, every prefix as a list of its own."""
    table = "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: xor(a // 256, crc_table[xor(a % 256, b) + 1])), 4294967295)"
    return f"""WITH x AS MATERIALIZED (SELECT {table} AS crc_table),
t AS MATERIALIZED (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS MATERIALIZED (SELECT conv_id, s, CAST({crc} % {HEADS} AS BIGINT) AS h FROM t, x),
r AS MATERIALIZED (SELECT c.conv_id, list_concat(CASE WHEN d.s IS NULL OR h = 0 THEN [] ELSE d.s[1:h] END, c.s[h + 1:]) AS s FROM c LEFT JOIN t d ON d.conv_id = c.conv_id - c.conv_id % {GROUP}),
m AS MATERIALIZED (SELECT conv_id AS member, d, s, min(conv_id) OVER (PARTITION BY d, CASE WHEN d = 0 THEN [] ELSE s[1:d] END) AS node FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT node, d, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN len(regexp_extract_all(s[d].text, '{_WORD}')) ELSE 0 END) AS words FROM m GROUP BY node, d),
p AS MATERIALIZED (SELECT n.*, m.node AS parent FROM n LEFT JOIN m ON m.member = n.node AND m.d = n.d - 1),
k AS MATERIALIZED (SELECT p.*, coalesce(c.n_children, 0) AS n_children FROM p LEFT JOIN (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM p WHERE d > 0 GROUP BY ALL) c USING (node, d)),
below AS (SELECT u.node, u.d, count(*) FILTER (v.n_children = 0) AS n_leaves, CAST(sum((v.n_convs - 1) * v.words) AS BIGINT) AS saved_tokens FROM k v JOIN m u ON u.member = v.node AND u.d <= v.d GROUP BY ALL),
e AS (SELECT node, d, sha256(string_agg(CAST(member AS VARCHAR), ',' ORDER BY member)) AS ends_sha256 FROM m WHERE len(s) = d GROUP BY ALL)
SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(ends_sha256, '{EMPTY}') AS ends_sha256 FROM k JOIN below USING (node, d) LEFT JOIN e USING (node, d)"""
