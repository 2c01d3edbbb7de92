"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of (source, language, topic). Raking scales
the cells' token weights until each of the three marginals has its target
share; by default a target is the value's share of tokens to the power 0.5, so
that a source with a third of all tokens is drawn down and rare values are
drawn up. The weights become probabilities min(1, c w), where c is chosen so
that the expected tokens are ``keep`` of all tokens. Raking goes on until no
marginal is further from its target than ``RESIDUAL`` of it, or until rounds no longer bring
it nearer: targets that no weights can meet (a source in one language only,
say) leave a residual, which the cells state. A document is kept if a number
that follows from its id alone is below its cell's probability: the same
documents are kept on every run and every layout.

Only counts are shuffled before the cells; there is one row per cell. The cells
are raked in one partition up to ``CELLS_IN_ONE`` of them, else over several.

Defined results: a null source or language is a value of its own, a document
without a topic has topic -1; null, empty or blank texts have 0 tokens and the
probability of their cell; repeated rows of an id share its decision; a null id
is never kept; further columns don't matter; an empty table gives an
empty result. Tokens are runs without blanks, tabs and line ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unit

SIDES = ("source", "lang", "topic")
POWER = 0.5
#: Rounds between two looks at the residual, and the residual that ends them.
ROUNDS = 10
RESIDUAL = 1e-10
KEEP = 0.8
CELLS_IN_ONE = 200_000
#: Share of the residual that a run of rounds must take off.
STILL = 1e-3
PLACES = 6
SALT = "mix"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def described(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, tokens. topics: vec_id, label."""
    by_id = topics.filter("vec_id is not null").groupBy(F.col("vec_id").alias("doc_id")).agg(F.min("label").alias("topic"))
    narrow = docs.select("doc_id", *[F.coalesce(F.col(c), F.lit("(none)")).alias(c) for c in ("source", "lang")], tokens(F.col("text")).alias("tokens"))
    return narrow.join(by_id, "doc_id", "left").withColumn("topic", F.coalesce("topic", F.lit(-1)))


def raked(cells: DataFrame, power: float = POWER, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``weight`` and ``residual`` to the cells (SIDES, docs, tokens).

    Raking goes on while it gets nearer to its targets, however slowly. It ends
    at RESIDUAL, or once three runs of rounds in a row have not lowered the
    residual by STILL of itself: then no weights of these cells meet the targets,
    and ``residual`` says how far the worst marginal is off.
    """
    whole = F.lit(cells.agg(F.sum("tokens")).first()[0] or 0).cast("double")
    for side in SIDES:
        own = Window.partitionBy(side)
        cells = cells.withColumn(f"t_{side}", F.pow(F.sum("tokens").over(own).cast("double"), F.lit(power)))
    for side in SIDES:
        total = cells.groupBy(side).agg(F.first(f"t_{side}").alias("t")).agg(F.sum("t")).first()[0] or 1.0
        cells = cells.withColumn(f"t_{side}", whole * F.col(f"t_{side}") / F.lit(total))
    cells, left, still = cells.withColumn("weight", F.lit(1.0)), math.inf, 0
    while True:
        for _ in range(rounds):
            for side in SIDES:
                now = F.sum(F.col("weight") * F.col("tokens")).over(Window.partitionBy(side))
                cells = cells.withColumn("weight", F.col("weight") * F.coalesce(F.try_divide(F.col(f"t_{side}"), now), F.lit(1.0)))
        cells, before = cut(cells), left
        left = residual(cells)
        still = still + 1 if left > (1 - STILL) * before else 0
        if left <= RESIDUAL or still == 3:
            return cells.select(*SIDES, "docs", "tokens", "weight", F.lit(left).alias("residual"))


def residual(cells: DataFrame) -> float:
    """How far a marginal of the raked cells is from its target at most, as a share of it."""
    off = [F.max(F.abs(F.coalesce(F.try_divide(f"m_{s}", f"t_{s}"), F.lit(1.0)) - 1)) for s in SIDES]
    for side in SIDES:
        cells = cells.withColumn(f"m_{side}", F.sum(F.col("weight") * F.col("tokens")).over(Window.partitionBy(side)))
    return cells.agg(F.greatest(*off)).first()[0] or 0.0


def calibrated(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """Adds ``p`` = min(1, c weight), with the c that keeps ``keep`` of the tokens.

    c only grows while more cells reach 1, so it ends once none is new.
    """
    c, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(c) >= 1
        t, n, taken, rest = cells.agg(F.sum("tokens"), F.count_if(full), F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight") * F.col("tokens")))).first()
        if not rest or n == capped:
            break
        c, capped = (keep * t - taken) / rest, n
    return cells.withColumn("p", F.round(F.least(F.lit(1.0), F.col("weight") * F.lit(c)), PLACES))


def mix(docs: DataFrame, topics: DataFrame, power: float = POWER, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """doc_id, source, lang, topic, tokens, p, kept of every document."""
    each = described(docs, topics)
    cells = cut(each.groupBy(*SIDES).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")))
    n = cells.count()
    cells = cut(calibrated(raked(cells.coalesce(max(1, math.ceil(n / CELLS_IN_ONE))), power, rounds), keep))
    cells = cells.select(*SIDES, "p")
    if n <= CELLS_IN_ONE:  # about 100 bytes each
        cells = F.broadcast(cells)
    return each.join(cells, list(SIDES)).select("doc_id", *SIDES, "tokens", "p", ((unit("doc_id", salt=SALT) < F.col("p")) & F.col("doc_id").isNotNull()).alias("kept"))


def sample(docs: DataFrame, topics: DataFrame, **settings) -> DataFrame:
    """The documents that ``mix`` keeps, with all their columns."""
    kept = mix(docs, topics, **settings).filter("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def oracle(docs: str = "documents", power: float = POWER, rounds: int = 40, keep: float = KEEP, caps: int = 12) -> str:
    """DuckDB SQL for ``mix``: enough rounds and caps to converge are written out."""
    sql = [f"""e AS (SELECT d.doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(v.topic, -1) AS topic,
  CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) AS BIGINT) AS tokens
  FROM {docs} d LEFT JOIN (SELECT vec_id AS doc_id, min(label) AS topic FROM embeddings GROUP BY vec_id) v USING (doc_id))""",
           "c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM e GROUP BY ALL)",
           "g AS (SELECT sum(tokens) AS whole FROM c)"]
    for s in SIDES:
        sql.append(f"t_{s} AS (SELECT {s}, power(sum(tokens), {power}) AS t FROM c GROUP BY {s})")
        sql.append(f"u_{s} AS (SELECT {s}, (SELECT whole FROM g) * t / (SELECT sum(t) FROM t_{s}) AS t FROM t_{s})")
    sql.append("w0 AS (SELECT *, 1.0::DOUBLE AS w FROM c)")
    last = "w0"
    for i in range(rounds):
        for s in SIDES:
            new = f"w{i}_{s}"
            sql.append(f"{new} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.w * coalesce(u.t / nullif(sum(c.w * c.tokens) OVER (PARTITION BY c.{s}), 0), 1.0) AS w FROM {last} c JOIN u_{s} u USING ({s}))")
            last = new
    sql.append(f"k0 AS (SELECT {keep} * (SELECT whole FROM g) / nullif(sum(w * tokens), 0) AS c FROM {last})")
    for i in range(1, caps + 1):
        sql.append(f"k{i} AS MATERIALIZED (SELECT coalesce(({keep} * (SELECT whole FROM g) - sum(CASE WHEN w * p.c >= 1 THEN tokens ELSE 0 END)) / nullif(sum(CASE WHEN w * p.c >= 1 THEN 0 ELSE w * tokens END), 0), any_value(p.c)) AS c FROM {last}, k{i - 1} p)")
    sql.append(f"p AS (SELECT source, lang, topic, round(least(1.0, w * (SELECT c FROM k{caps})), {PLACES}) AS p FROM {last})")
    return "WITH " + ",\n".join(sql) + f"""
SELECT e.doc_id, e.source, e.lang, e.topic, e.tokens, p.p, CAST('0x' || substr(md5('{SALT}|' || coalesce(e.doc_id::VARCHAR, '')), 1, 8) AS BIGINT) / 4294967296.0 < p.p AND e.doc_id IS NOT NULL AS kept
FROM e JOIN p USING (source, lang, topic)"""
