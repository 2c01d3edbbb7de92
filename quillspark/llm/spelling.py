"""Spelling variants by reduced-alphabet generation.

Letters are hashed to five symbols. Of each reduced word the one-edit
neighbourhood is generated: the word itself, all its deletions, and all
replacements; a pair that differs by an insertion is met from its longer word,
and one by a replacement from the higher symbol, so each pair is generated once.
Neighbours join the vocabulary's reduced words and are verified on the original
strings. A word with one edit keeps its first three letters (an edit in its
second half) or its last three (in its first half); these letters stand in the
join's key beside the reduced neighbour, in two rows for each vocabulary word,
which keeps words apart that only look alike in five symbols.

Keys are sums of symbols times powers of a number, so that a neighbour costs
one addition however long its word is, and hash collisions end at the
verification. Words are counted before any of this; what is joined is the
vocabulary, not the text.

Defined results: null texts and empty ones have no words, a null id counts as
an empty one in the hash that decides on deletions; repeated rows count twice;
ties go to the word that is smaller in code-point order; an empty table gives
an empty vocabulary; further columns don't matter; texts and words of any
length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _power, mix, stored

#: Symbols that letters are hashed to, and letters of a word's end that stand in the key.
SYMBOLS, ENDS = 5, 3
#: Code points and occurrences that a word needs; times that a form must be as frequent as its variant.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
DELETED_OF = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTER = r"A-Za-zÀ-ÿ"
#: Letters that are spread at once, and in a word from which its neighbours carry a short name.
LETTERS, LONG = 200_000, 48


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: runs of Latin letters, A-Z lower-cased, some with a letter deleted.

    Only runs that are long enough are cut out, as a deletion makes none longer.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(f"[{_LETTER}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % DELETED_OF == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _keyed(ids: np.ndarray, sums: np.ndarray, front: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Join keys: the sum of a reduced word with the letters that the edit left alone."""
    return mix(sums ^ mix(np.where(front, ends[0][ids], ends[1][ids]))).view(np.int64)


def _spread(words: pa.Array, neighbours: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, key, front) of the words' reduced forms, or of their neighbours one edit away.

    front: the edit is in the second half, so the key holds the first letters.
    """
    raw = "".join(words.to_pylist()).encode("latin-1")
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.frombuffer(raw, np.uint8)
    start = np.r_[0, np.cumsum(size)[:-1]]
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(letters)) - start[word]
    symbol = (letters % SYMBOLS).astype(np.uint64)
    up, down = _power(int(size.max(initial=1)))
    part = (symbol + np.uint64(1)) * up[place]
    upto = np.r_[np.uint64(0), np.cumsum(part, dtype=np.uint64)]
    whole = upto[start + size] - upto[start]
    code = lambda first: sum(letters[first + i].astype(np.uint64) << np.uint64(8 * i) for i in range(ENDS))
    ends = code(start), code(start + size - ENDS) | np.uint64(1 << 40)
    ids, sums, front = [], [], []
    if not neighbours:
        every = np.arange(len(size))
        ids, sums, front = [every, every], [whole, whole], [np.ones(len(size), bool), np.zeros(len(size), bool)]
    else:
        late = place >= size[word] // 2
        for less in range(1, SYMBOLS):
            at = np.flatnonzero(symbol >= less)
            ids.append(word[at])
            sums.append(whole[word[at]] - np.uint64(less) * up[place[at]])
            front.append(late[at])
        # a run of one symbol gives one deletion, in each half that it reaches
        last = np.ones(len(letters), bool)
        last[:-1] = (symbol[1:] != symbol[:-1]) | (word[1:] != word[:-1]) | (late[1:] != late[:-1])
        at = np.flatnonzero(last)
        ids.append(word[at])
        sums.append((upto[at] - upto[start[word[at]]]) + (upto[(start + size)[word[at]]] - upto[at + 1]) * down[1])
        front.append(late[at])
    ids, front = np.concatenate(ids), np.concatenate(front)
    return ids, _keyed(ids, np.concatenate(sums), front, ends), front


def _slices(words: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, after the last) of runs of words with about LETTERS letters, or of one word."""
    upto = np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LETTERS, "right")))
        yield at, end
        at = end


def _rows(neighbours: bool):
    """Rows (key, name, n) of neighbours, or (key, name, n, front) of reduced words; neighbours are many and travel without what their key tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in _slices(batch.column(0)):
                some = batch.slice(at, end - at)
                ids, keys, front = _spread(some.column(0), neighbours)
                for i in range(0, len(ids), 200_000):
                    part = slice(i, i + 200_000)
                    chosen = pa.array(ids[part])
                    columns = [pa.array(keys[part]), some.column(1).take(chosen), some.column(2).take(chosen)]
                    yield pa.RecordBatch.from_arrays(columns if neighbours else [*columns, pa.array(front[part])], names=["key", "name", "n", "front"][: 3 if neighbours else 4])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of words one edit apart, once. words: word (letters up to U+00FF, at least 7), n.

    Neighbours one edit away meet the vocabulary from one side; words whose
    reduced forms are the same meet each other. A neighbour carries its word, or
    a short name of one over LONG letters, whose neighbours are as many as its
    letters; its name is looked up after the join.
    """
    long = F.length("word") > LONG
    name = F.concat(F.lit("#"), F.hex(F.xxhash64("word")))  # no word has such letters
    made = lambda some, by: some.select("word", by.alias("name"), "n").mapInArrow(_rows(True), "key long, name string, n long")
    b = words.select("word", F.col("word").alias("name"), "n").mapInArrow(_rows(False), "key long, name string, n long, front boolean")
    b = b.select("key", "front", F.col("name").alias("b"), F.col("n").alias("n_b"))
    same = b.select("key", F.col("b").alias("a"), F.col("n_b").alias("n_a"))
    short = made(words.filter(~long), F.col("word")).select("key", F.col("name").alias("a"), F.col("n").alias("n_a"))
    far = made(words.filter(long), name).select("key", "name", F.col("n").alias("n_a")).join(b.filter(F.length("b") >= LONG), "key").join(words.filter(long).select(name.alias("name"), F.col("word").alias("a")), "name")
    half = F.floor(F.length("a") / 2).cast("int")
    starts_alike = F.substring("a", F.lit(1), half) == F.substring("b", F.lit(1), half)
    beside = F.when(F.length("a") <= LONG, F.levenshtein("a", "b", 1) == 1).otherwise(_one_edit(F.col("a"), F.col("b")))
    apart = lambda met: met.filter(starts_alike == F.col("front")).filter(beside).select("a", "n_a", "b", "n_b")
    return apart(short.join(b, "key")).unionByName(apart(same.join(b, "key").filter("a < b"))).unionByName(apart(far))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether a long word turns into another, as long or one letter shorter, by one edit: the places where they first differ from either end."""
    n = F.length(a)
    place = lambda x, y: F.array_position(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.coalesce(p != q, F.lit(True))), True)
    first, last = place(a, b), place(F.reverse(a), F.reverse(b))
    return (a != b) & F.when(n == F.length(b), first + last == n + 1).otherwise((n == F.length(b) + 1) & (first + last >= n + 1))


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, form, n_near, form_n: the most frequent near word, if it is frequent enough."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = words.join(best, "word", "left")
    often = -F.col("best.less") >= TIMES * F.col("n")
    return out.select("word", "n", F.when(often, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, -F.col("best.less")).alias("form_n"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of some documents (doc_id, text)."""
    words = stored(vocabulary(docs), "words")
    table = stored(forms(words, near_pairs(words)), "forms")
    # counts grow by TIMES from form to form, so the largest bounds the steps
    most, steps = table.agg(F.max("form_n")).first()[0] or 0, 0
    while LEAST_COUNT * TIMES ** (steps + 1) <= most:
        steps += 1
    onward = table.filter("form is not null").select(F.col("word").alias("at"), F.col("form").alias("next"))
    ends = table.filter("form is not null").select("word", F.col("form").alias("at"))
    for _ in range(steps - 1):
        ends = ends.join(onward, "at", "left").select("word", F.coalesce("next", "at").alias("at"))
    out = table.join(ends.withColumnRenamed("at", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """DuckDB SQL of the query: near words share a word with one letter out, or are one."""
    table = "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END)))"
    octets = "flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, ord(c) - 64] END))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda a, b: xor(a // 256, crc_table[xor(a % 256, b) + 1])), 4294967295)"
    return f"""WITH RECURSIVE x AS MATERIALIZED (SELECT {table} AS crc_table),
r AS MATERIALIZED (SELECT doc, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS k FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE len(run) >= {LEAST_LENGTH} GROUP BY ALL),
h AS MATERIALIZED (SELECT run, k, CAST({crc} AS BIGINT) AS h FROM r, x),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {DELETED_OF} = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, k FROM h) WHERE len(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
o AS MATERIALIZED (SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(len(word))) AS i FROM w)),
p AS MATERIALIZED (SELECT x.word, y.word AS near, y.n AS near_n FROM o x JOIN o y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT o.word, w.word, w.n FROM o JOIN w ON o.rest = w.word UNION SELECT w.word, o.word, o.n FROM o JOIN w ON o.rest = w.word),
b AS (SELECT word, count(*) AS n_near, arg_max(near, (near_n, -r)) AS near, max(near_n) AS near_n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near) AS r FROM p) GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * w.n THEN near END AS form, CASE WHEN near_n >= {TIMES} * w.n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL),
e AS (SELECT c.word, c.at AS root FROM c JOIN f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN e USING (word)"""
