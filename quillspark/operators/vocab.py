"""Vocabulary matching by trigram similarity: blocks of words meet blocks of names, whose bitmaps of each trigram are added up."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold

SUGGEST, HINT = 0.3, 0.4
MOST = 10
#: Words and names of a block at most, about; bitmaps that a block of names keeps (16 KB each); words whose sums are held at once, and pairs that are sifted at once.
WORDS, NAMES = 2**17, 2**17
MAPS, _ROWS = 2**12, 64
_PAIRS = 2**19
_FOUND = "word string, name string, lang string, df long, starts int, sim double"


def _plain(c: Column) -> Column:
    """The lower-case alphanumeric words that trigrams are made of, between blanks."""
    return F.array_join(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")


def _met(words: DataFrame, names: DataFrame, threshold: float, k: int | None = None, own: str = "", by_lang: bool = False) -> DataFrame:
    """(word, name, lang, df, starts, sim) of the pairs whose similarity reaches the threshold (over 0).

    words: (word); names: (name, lang, df). With own = "starts" names that start
    with the word come too, and first; with own = "holds" names that hold it,
    without regard to case. With k only what may be among a word's k best by
    (starts, sim, df, name, lang), of each language if by_lang.

    Words and names are dealt into blocks by hash, and each pair of blocks is a
    cell of its own, so memory follows the size of a block and only pairs that
    are near enough are made. In a cell, the names of each trigram are a bitmap
    (names stand by size); a word adds up the bitmaps of its trigrams, one bit
    of the sums a plane, and names whose sum reaches what their size needs are
    measured.
    """
    spark = words.sparkSession
    w = words.select("word").filter("word is not null").distinct()
    n = names.select("name", "lang", F.col("df").cast("long").alias("df")).filter("name is not null")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n_words, across = w.count(), max(1, -(-n.count() // NAMES))
    down = max(1, -(-n_words // WORDS), min(-(-n_words // 2**13), -(-tasks // across)))  # small tables are dealt over the tasks too

    def side(df: DataFrame, name: str, own_blocks: int, cell: str, other: int, fields: list) -> DataFrame:
        at = df.withColumns({"own": F.pmod(F.xxhash64(name), F.lit(own_blocks)), "other": F.explode(F.sequence(F.lit(0), F.lit(other - 1)))})
        forms = [F.nullif(f(F.col(name)), F.col(name)).alias(x) for x, f in (("plain", _plain), ("low", F.lower))]
        return at.select(F.expr(cell).alias("cell"), F.struct(name, *forms, *fields).alias("x")).repartition(tasks, "cell").groupBy("cell").agg(F.collect_list("x").alias(name + "s"))

    rows = side(w, "word", down, f"own * {across} + other", across, []).join(side(n, "name", across, f"other * {across} + own", down, ["lang", "df"]), "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield from _cell(*(batch.column(c).slice(i, 1).flatten() for c in range(2)), threshold, k, own, by_lang)

    return rows.select("words", "names").mapInArrow(run, _FOUND)


def _forms(rows: pa.StructArray) -> tuple[list[str], list[str], list[str]]:
    """Names, their alphanumeric words and their lower case; a form that doesn't differ is null."""
    names, plain, low = (rows.field(i).to_numpy(zero_copy_only=False).tolist() for i in range(3))
    return names, [n if p is None else p for n, p in zip(names, plain)], [n if x is None else x for n, x in zip(names, low)]


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All trigrams, ascending, and (place among them, text) of each distinct one of a text, in this order; each word has two blanks before and one behind."""
    blob = "\r".join("  " + t.replace(" ", " \n  ") + " " for t in texts)
    c = np.frombuffer(blob.encode("utf-32-le", "surrogatepass"), np.uint32)
    apart = (c == 10) | (c == 13)
    ok = ~(apart[:-2] | apart[1:-1] | apart[2:] | ((c[1:-1] == 32) & (c[2:] == 32)))  # three blanks stand for a text without words
    text = np.cumsum(c == 13)[:-2][ok]
    wide = c.astype(np.uint64)
    each = (wide[:-2] | wide[1:-1] << np.uint64(21) | wide[2:] << np.uint64(42))[ok]
    codes = _distinct(each)
    key = _distinct(np.searchsorted(codes, each) * len(texts) + text)
    return codes, key // len(texts), key % len(texts)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def _set(out: np.ndarray, at: np.ndarray) -> None:
    """Set ascending bits of a zeroed bitmap."""
    cell = at >> 6
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    out[cell[first]] = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)


def _needs(x: int, threshold: float, first: list[int]) -> list[tuple[int, int, int]]:
    """(overlap, from, to): the 64-name stretches of a bitmap whose sizes need an overlap with a set of x; first: where each size begins."""
    out: list[list[int]] = []
    for y in range(max(1, math.ceil(threshold * x - 1e-9)), min(math.floor(x / threshold + 1e-9), len(first) - 2) + 1):
        least, low, high = max(1, math.ceil(threshold / (1 + threshold) * (x + y) - 1e-9)), first[y], first[y + 1]
        if low < high and least <= min(x, y):
            if out and out[-1][0] == least:
                out[-1][2] = -(-high // 64)
            else:
                out.append([least, low // 64, -(-high // 64)])
    return [(m, a, b) for m, a, b in out]


def _cell(word_rows: pa.StructArray, name_rows: pa.StructArray, threshold: float, k: int | None, own: str, by_lang: bool) -> Iterator[pa.RecordBatch]:
    words, plain_words, low_words = _forms(word_rows)
    codes, gram, owner = _trigrams(_forms(name_rows)[1])
    by_size = np.argsort(np.bincount(owner, minlength=len(name_rows)), kind="stable")
    back = np.empty(len(by_size), np.int64)
    back[by_size] = np.arange(len(by_size))
    name_rows, owner = name_rows.take(pa.array(by_size)), back[owner]
    names, _, low_names = _forms(name_rows)
    langs = name_rows.field(3).to_numpy(zero_copy_only=False).tolist()
    kinds = {x: i for i, x in enumerate(sorted(set(langs), key=lambda x: (x is not None, x)))}
    kind = np.array([kinds[x] for x in langs], np.int64)
    place = np.empty(len(names), np.int64)  # in the order that ties go by: df, name, language
    if k:
        df = name_rows.field(4)
        order = np.array(sorted(np.argsort(kind, kind="stable").tolist(), key=names.__getitem__), np.int64)
        order = order[np.lexsort((-df.fill_null(0).to_numpy(zero_copy_only=False)[order], df.is_null().to_numpy(zero_copy_only=False)[order]))]
        place[order] = np.arange(len(names))
    kind = kind if by_lang else np.zeros(len(names), np.int64)
    name_size = np.bincount(owner, minlength=len(names))
    first = np.searchsorted(name_size, np.arange(name_size.max(initial=0) + 2)).tolist()

    owner = owner[np.lexsort((owner, gram))]
    edge = np.searchsorted(gram, np.arange(len(codes) + 1))
    wide = -(-len(names) // 64)
    often = np.argsort(-np.diff(edge), kind="stable")[:MAPS]
    maps: list[np.ndarray | None] = [None] * len(codes)
    for g, row in zip(often.tolist(), np.zeros((len(often), wide), np.uint64)):
        _set(row, owner[edge[g] : edge[g + 1]])
        maps[g] = row

    def bitmap(g: int) -> np.ndarray:
        if maps[g] is not None:
            return maps[g]
        row = np.zeros(wide, np.uint64)  # a rare one
        _set(row, owner[edge[g] : edge[g + 1]])
        return row

    own_codes, gram, holder = _trigrams(plain_words)
    word_size = np.bincount(holder, minlength=len(words))
    spot = np.searchsorted(codes, own_codes)
    spot[(codes[np.minimum(spot, len(codes) - 1)] != own_codes) if len(codes) else slice(None)] = -1  # no name has it
    # a word's trigrams without blanks come first: a name that holds the word has all of them
    padded = ((own_codes & np.uint64(2**21 - 1)) == 32) | ((own_codes >> np.uint64(42)) == 32)
    wanted = spot[gram[np.lexsort((padded[gram], holder))]].tolist()
    bare_size, start = np.bincount(holder[~padded[gram]], minlength=len(words)), np.r_[0, np.cumsum(word_size)].tolist()
    if own == "starts":
        lex = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        sorted_names = [names[i] for i in lex]
    needs: dict[int, list] = {}
    planes = np.zeros((_ROWS, int(word_size.max(initial=1)).bit_length(), wide), np.uint64)
    reached = np.zeros((_ROWS, wide), np.uint64)
    carry, next_carry = np.empty(wide, np.uint64), np.empty(wide, np.uint64)

    def bits(rows: np.ndarray) -> np.ndarray:
        """The names that some bitmaps hold, as places in their rows laid end to end."""
        flat = rows.reshape(-1)
        some = np.flatnonzero(flat)
        at, bit = np.nonzero(np.unpackbits(flat[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return some[at] * 64 + bit

    def inside(i: int) -> np.ndarray:
        """The names that hold a word."""
        of = wanted[start[i] : start[i] + int(bare_size[i])]
        if not of or plain_words[i] != low_words[i]:
            maybe = range(len(names))
        elif min(of) < 0:
            return np.zeros(0, np.int64)
        else:
            both = bitmap(of[0])
            for g in of[1:]:
                both = both & bitmap(g)
            maybe = bits(both).tolist()
        return np.array([j for j in maybe if low_words[i] in low_names[j]], np.int64)

    def starting(word: str) -> np.ndarray:
        return lex[bisect_left(sorted_names, word) : bisect_right(sorted_names, word, key=lambda x: x[: len(word)])]

    def sifted(w: np.ndarray, n: np.ndarray, shared: np.ndarray, extra: np.ndarray) -> pa.RecordBatch:
        whole = word_size[w] + name_size[n] - shared
        sim = np.where(whole > 0, shared / np.maximum(whole, 1), 0.0)
        good = np.flatnonzero(extra | (sim >= threshold))
        w, n, sim, extra = w[good], n[good], sim[good], extra[good]
        if own and len(w):  # a pair that came both ways counts once, as an own one
            pair = np.lexsort((~extra, n, w))
            one = pair[np.r_[True, (np.diff(w[pair]) != 0) | (np.diff(n[pair]) != 0)]]
            w, n, sim, extra = w[one], n[one], sim[one], extra[one]
        starts = extra & (own == "starts")
        if k:
            best = np.lexsort((place[n], -sim, ~starts, kind[n], w))
            group = (w * len(kinds) + kind[n])[best]
            best = best[np.arange(len(best)) - np.searchsorted(group, group) < k]
            w, n, sim, starts = w[best], n[best], sim[best], starts[best]
        at = pa.array(n)
        return pa.RecordBatch.from_arrays([word_rows.field(0).take(pa.array(w)), *[name_rows.field(i).take(at) for i in (0, 3, 4)], pa.array(starts.astype(np.int32)), pa.array(sim)], names=["word", "name", "lang", "df", "starts", "sim"])

    held: list[tuple[np.ndarray, ...]] = []
    waiting = 0
    for low in range(0, len(words), _ROWS):
        rows = range(low, min(low + _ROWS, len(words)))
        reached[:] = 0
        extras = []
        for r, i in enumerate(rows):
            own_planes = planes[r]
            if (x := int(word_size[i])) not in needs:
                needs[x] = _needs(x, threshold, first)
            used = added = 0  # planes that hold sums, and what these can be at most
            for g in wanted[start[i] : start[i + 1]]:
                if g < 0:
                    continue
                add, added = bitmap(g), added + 1
                for p in range(used):
                    if p + 1 < added.bit_length():
                        np.bitwise_and(own_planes[p], add, out=next_carry)
                    np.bitwise_xor(own_planes[p], add, out=own_planes[p])
                    add, (carry, next_carry) = next_carry, (next_carry, carry)
                if added.bit_length() > used:
                    own_planes[used] = add
                    used += 1
            own_planes[used:] = 0
            for least, a, b in needs[x]:
                if least <= added:
                    enough: np.ndarray | None = None
                    for p in range(used):  # sum >= least, from the lowest bit on
                        plane = own_planes[p, a:b]
                        if least >> p & 1:
                            enough = plane if enough is None else plane & enough
                        elif enough is not None:
                            enough = plane | enough
                        else:
                            continue  # no lower bit asks for anything: every sum does
                    reached[r, a:b] |= enough
            if own:
                extras.append(starting(words[i]) if own == "starts" else inside(i))
        at = bits(reached[: len(rows)])
        r, n = at // (wide * 64), at % (wide * 64)
        extra = np.zeros(len(r), bool)
        if own:
            r, n = np.r_[r, np.repeat(np.arange(len(rows)), [len(x) for x in extras])], np.concatenate([n, *extras])
            extra = np.arange(len(r)) >= len(extra)
        bit = (n & 63).astype(np.uint64)
        shared = sum(((planes[r, p, n >> 6] >> bit & np.uint64(1)).astype(np.int64) << p for p in range(planes.shape[1])), np.zeros(len(r), np.int64))
        held.append((r + low, n, shared, extra))
        waiting += len(r)
        if waiting >= _PAIRS or rows[-1] == len(words) - 1:
            yield sifted(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            waiting = 0


def near(words: DataFrame, vocabulary: DataFrame, threshold: float) -> DataFrame:
    """(word, term, sim) of all pairs whose similarity reaches the threshold (over 0).

    words: (word); vocabulary: (term).
    """
    names = vocabulary.select(F.col("term").alias("name"), F.lit("").alias("lang"), F.lit(0).alias("df")).distinct()
    return _met(words, names, threshold).select("word", F.col("name").alias("term"), "sim")


def term_suggestions(words: DataFrame, terms: DataFrame, k: int = MOST) -> DataFrame:
    """(word, term, lang, starts, sim, rank): terms that start with a word or are near it.

    terms: (lang, term, df). The best of each block are found where the block
    is, so only k of them for each word are moved.
    """
    found = _met(words.filter("word <> ''"), terms.withColumnRenamed("term", "name"), SUGGEST, k, "starts").withColumnRenamed("name", "term")
    order = Window.partitionBy("word").orderBy(F.desc("starts"), F.desc("sim"), F.desc("df"), "term", "lang")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("word", "term", "lang", "starts", "sim", "rank")


def title_suggestions(words: DataFrame, titles: DataFrame, k: int = MOST) -> DataFrame:
    """(word, title, lang, starts, sim, rank): titles that hold a word or are near it.

    titles: (lang, title). A title that holds an alphanumeric word has its
    trigrams, so only such titles are looked through.
    """
    t = titles.select("lang", F.col("title").alias("name"), F.lit(0).alias("df")).distinct()
    found = _met(words.filter("word <> ''"), t, SUGGEST, k, "holds", by_lang=True).withColumnRenamed("name", "title")
    starts = F.startswith(F.lower("title"), F.col("word")).cast("int")
    order = Window.partitionBy("word", "lang").orderBy(F.desc("sim"), "title")
    return found.withColumns({"starts": starts, "rank": F.row_number().over(order)}).filter(F.col("rank") <= k).select("word", "title", "lang", "starts", "sim", "rank")


def suggestions(words: DataFrame, terms: DataFrame, titles: DataFrame, k: int = MOST) -> DataFrame:
    """(word, text, kind, lang, rank): terms and titles merged, best first."""
    both = term_suggestions(words, terms, k).select("word", F.col("term").alias("text"), F.lit("term").alias("kind"), "lang", "starts", "sim").unionByName(
        title_suggestions(words, titles, k).select("word", F.col("title").alias("text"), F.lit("chapter").alias("kind"), "lang", "starts", "sim")
    )
    order = Window.partitionBy("word").orderBy(F.desc("starts"), F.desc("sim"), F.desc(F.col("kind") == "term"), "text", "lang")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("word", "text", "kind", "lang", "rank")


def closest(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, term, sim): the nearest term of each word, by similarity, df, then name."""
    names = terms.select(F.col("term").alias("name"), F.lit("").alias("lang"), "df")
    order = Window.partitionBy("word").orderBy(F.desc("sim"), F.desc("df"), "name")
    best = _met(words, names, HINT, 1).withColumn("r", F.row_number().over(order)).filter("r = 1")
    return best.select("word", F.col("name").alias("term"), "sim")


def did_you_mean(queries: DataFrame, terms: DataFrame, most: int = 10, found: DataFrame | None = None) -> DataFrame:
    """(query_id, hint): the first words with unknown ones replaced; null if nothing changes.

    found: (query_id) of queries that have results, which get no row.
    """
    if found is not None:
        queries = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    words = queries.select("query_id", F.posexplode(F.slice(F.split(F.trim("text"), r"\s+"), 1, most)).alias("pos", "raw")).withColumn("word", fold(F.col("raw")))
    unknown = words.filter("word <> ''").join(terms.select(F.col("term").alias("word")).distinct(), "word", "left_anti")
    best = closest(unknown, terms).select("word", F.col("term").alias("fix"))
    fixed = words.join(unknown.select("word").distinct().join(best, "word"), "word", "left")
    return fixed.groupBy("query_id").agg(
        F.when(F.max(F.col("fix").isNotNull()), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("fix", "raw").alias("w")))), lambda s: s["w"]), " ")).alias("hint")
    )
