"""Quality rules as a bitmask ledger.

``ledger`` reads each text once and stores the measurements and one bit for each
rule that it fails. Policies are versioned sets of rules: ``judged`` applies one
by a mask over the stored bits, ``ablations`` tells what each of its rules
decides alone by counting bit patterns, of which there are at most two to the
number of rules. Neither reads a text again, so an older or newer version of a
policy costs a scan of the ledger.

Texts are measured where they lie, a few hundred KB at a time: nothing is
shuffled, and a very long text is only as large as itself.

Defined results: a null text has no words and fails ``few_words``; an empty
table gives an empty ledger, ablations then count 0; repeated rows and rows
without an id are judged each by itself; further columns don't matter, whatever
their names. Words and lines count as equal if their 64-bit hashes do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, span_hashes

#: Words in a window that counts as repeated if it stands in the text twice.
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")

#: Rules in the order of their bits, as SQL conditions of failure over the measurements. Bits are never reused: a changed rule gets a new name and the next bit.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "stutter": "10 * n_stutter > 3 * n_words",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 10 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Policies by version.
POLICIES = {
    "base": BASE,
    "symbols-1": (*BASE, "many_symbols"),
    "web-1": (*BASE, "many_symbols", "repeated_lines", "stutter"),
    "web-2": tuple(RULES),
}
CURRENT = "web-2"

#: The bytes of white space and of symbols.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LATER = (np.arange(256) & 0xC0) == 0x80  # all bytes of a character but its first
_CHUNK = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many flags are set between one edge and the next."""
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[edges[1:]] - total[edges[:-1]]


def _first_of_its_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where each different value of a text stands for the first time."""
    return np.unique(mix(hashes + text.astype(np.uint64) * _ODD), return_index=True)[1]


def measure(raw: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
    """Measurements of the texts between the edges of UTF-8 bytes; each text ends in an added newline."""
    n = len(edges) - 1
    inside = ~_SPACE[raw]
    turn = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    first, last = turn[::2], turn[1::2]
    text = np.searchsorted(edges, first, "right") - 1
    words = span_hashes(raw, first, last)
    per_text = lambda at: np.bincount(at, minlength=n).astype(np.int64)

    breaks = np.flatnonzero(raw == 10)
    starts = np.r_[0, breaks[:-1] + 1]
    upto = np.r_[0, np.cumsum(inside)]
    full = upto[breaks] > upto[starts]
    starts, breaks = starts[full], breaks[full]
    line_text = np.searchsorted(edges, starts, "right") - 1
    lines = per_text(line_text)
    different = per_text(line_text[_first_of_its_text(span_hashes(raw, starts, breaks), line_text)])

    repeated = np.zeros(len(words) + 1, np.int64)
    if len(words) >= WINDOW:
        size = len(words) - WINDOW + 1
        whole = text[:size] == text[WINDOW - 1 :]
        run = np.zeros(size, np.uint64)
        for j in range(WINDOW):
            run = run * _ODD + words[j : j + size]
        at = np.flatnonzero(whole)
        _, which, often = np.unique(mix(run[at] + text[at].astype(np.uint64) * _ODD), return_inverse=True, return_counts=True)
        twice = at[often[which] > 1]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + WINDOW, -1)
    same = (words[1:] == words[:-1]) & (text[1:] == text[:-1]) if len(words) else np.zeros(0, bool)
    return {
        "n_words": per_text(text), "word_chars": _sums(inside & ~_LATER[raw], edges), "n_symbols": _sums(_SYMBOL[raw], edges),
        "n_lines": lines, "n_dup_lines": lines - different, "n_repeat_words": per_text(text[np.cumsum(repeated)[:-1] > 0]), "n_stutter": per_text(text[1:][same]) if len(words) else per_text(text),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + _CHUNK, "right")) - 1)
            sizes = np.diff(at[begin : end + 1]) + 1
            edges = np.r_[0, np.cumsum(sizes)]
            raw = np.full(edges[-1], 10, np.uint8)
            kept = np.ones(edges[-1], bool)
            kept[edges[1:] - 1] = False
            raw[kept] = data[at[begin] : at[end]]
            got = measure(raw, edges)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *[pa.array(got[m]) for m in MEASURES]], names=["doc_id", *MEASURES])
            begin = end


def failures() -> Column:
    """The bits of the rules that a row's measurements fail."""
    return reduce(Column.bitwiseOR, [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())])


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(1 << list(RULES).index(rule) for rule in POLICIES[policy])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed``: a bit for each rule that the text fails."""
    kind = dict(docs.dtypes)["doc_id"]
    measured = docs.select("doc_id", "text").mapInArrow(_measured, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return measured.withColumn("failed", failures())


def judged(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger with ``base_failed``, ``kept`` and the policy's version."""
    hit = lambda name: F.col("failed").bitwiseAND(F.lit(mask(name)).cast("long")) != 0
    return rows.withColumns({"base_failed": hit("base"), "kept": ~hit("base") & ~hit(policy), "policy": F.lit(policy)})


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, failed, failed_alone, kept, kept_without) of a policy's rules.

    failed_alone: rows that fail no other rule of the policy; kept_without: what
    the policy would keep without the rule. One count of bit patterns serves all rules.
    """
    own = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    bits = F.col("bits")
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    cells = []
    for rule in POLICIES[policy]:
        bit = F.lit(1 << list(RULES).index(rule)).cast("long")
        cells.append(F.struct(F.lit(rule).alias("rule"), n(bits.bitwiseAND(bit) != 0).alias("failed"), n(bits == bit).alias("failed_alone"), n(bits == 0).alias("kept"), n(bits.bitwiseAND(F.bitwise_not(bit)) == 0).alias("kept_without")))
    return own.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def oracle() -> str:
    """DuckDB SQL of the query: words, lines and windows as rows of a table."""
    rule = lambda name: f"({RULES[name]})"
    bits = " + ".join(f"CASE WHEN {r} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES.values()))
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k),
win AS (SELECT k, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS often FROM win) WHERE often > 1),
rep AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY k),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_stutter FROM d LEFT JOIN ln USING (k) LEFT JOIN rep USING (k)),
j AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {' OR '.join(map(rule, BASE))} AS base_failed, NOT ({' OR '.join(map(rule, dict.fromkeys(BASE + POLICIES[CURRENT])))}) AS kept, failed FROM j"""
