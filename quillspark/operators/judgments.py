"""Pools, assignments, labels, agreement, reviews of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .corpus import renumbered


def pool(run: DataFrame, depth: int = 50) -> DataFrame:
    """(query_id, doc_id) that any system ranks up to a depth."""
    return run.filter(F.col("rank") <= depth).select("query_id", "doc_id").distinct()


def pool_manifest(run: DataFrame, depth: int = 50) -> DataFrame:
    """(query_id, system, pool_size, contributed, unique_docs)."""
    top = run.filter(F.col("rank") <= depth).select("system", "query_id", "doc_id").distinct()
    n = top.withColumn("n", F.count("*").over(Window.partitionBy("query_id", "doc_id")))
    sizes = n.groupBy("query_id").agg(F.count_distinct("doc_id").alias("pool_size"))
    return n.groupBy("query_id", "system").agg(F.count("*").alias("contributed"), F.count_if(F.col("n") == 1).alias("unique_docs")).join(sizes, "query_id")


def missing_runs(run: DataFrame, systems: DataFrame, queries: DataFrame) -> DataFrame:
    """Expected (system, query_id) without any result."""
    names = [F.lit(name) for (name,) in systems.select("system").distinct().collect()]  # a few
    expected = queries.select(F.explode(F.array(*names)).alias("system"), "query_id") if names else systems.select("system").join(queries.select("query_id").limit(0))
    return expected.join(run.select("system", "query_id").distinct(), ["system", "query_id"], "left_anti")


def dealt(annotators: DataFrame, queries: DataFrame, each: int = 2, most: int = 3, taken: DataFrame | None = None) -> DataFrame:
    """(annotator_id, query_id): ``each`` queries in the order of sign-up, fewest seats first, then by id, on top of ``taken`` (query_id, seats).

    The queries of the lowest level are dealt in the order of their ids and rise
    by one; what is left of a level, fewer than ``each``, goes to one annotator
    together with the first queries above. So a level is one numbering of its
    queries, and only the few queries of such an annotator are looked up one by
    one. Levels are at most ``most``; a query with that many seats gets no more.
    """
    if each < 1:
        raise ValueError("an annotator gets at least one query")
    none = F.lit(0).cast("long")
    start = queries.select("query_id").distinct()
    start = start.withColumn("seats", none) if taken is None else start.join(taken.groupBy("query_id").agg(F.sum("seats").cast("long").alias("seats")), "query_id", "left").select("query_id", F.coalesce("seats", none).alias("seats"))
    state, wanted = stored(start), annotators.count()
    dealt_so_far, parts = 0, []
    for level in range(most):
        own = renumbered(state.filter(F.col("seats") == level).select("query_id"), ["query_id"], "place")
        n = own.count()
        if not n or dealt_so_far >= wanted:
            continue
        full = n // each * each
        parts.append(own.filter(F.col("place") <= full).select("query_id", (F.floor((F.col("place") - 1) / each) + dealt_so_far).alias("seat")))
        dealt_so_far += full // each
        lifted = F.when(F.col("seats") == level, F.col("seats") + 1).otherwise(F.col("seats"))
        if n > full:
            rest = [q for (q,) in own.filter(F.col("place") > full).select("query_id").collect()]  # fewer than each
            above = state.filter(~F.col("query_id").isin(rest)).withColumn("seats", lifted).filter(F.col("seats").between(level, most - 1))
            more = [q for (q,) in above.orderBy("seats", "query_id").limit(each - len(rest)).select("query_id").collect()]
            parts.append(state.filter(F.col("query_id").isin(rest + more)).select("query_id", F.lit(dealt_so_far).cast("long").alias("seat")))
            dealt_so_far += 1
            lifted = lifted + F.col("query_id").isin(more).cast("long")
        state = stored(state.withColumn("seats", lifted))
    signed = renumbered(annotators.select("annotator_id", "signed_up"), ["signed_up", "annotator_id"], "n").select("annotator_id", (F.col("n") - 1).alias("seat"))
    if not parts:
        return annotators.select("annotator_id").join(queries.select("query_id").limit(0))
    return reduce(DataFrame.unionByName, parts).join(signed, "seat").select("annotator_id", "query_id")


def latest_labels(events: DataFrame) -> DataFrame:
    """(annotator_id, query_id, doc_id, label, updated_at, replaced): the last event of each key."""
    return events.groupBy("annotator_id", "query_id", "doc_id").agg(F.max_by("label", F.struct("event_time", "event_id")).alias("label"), F.max("event_time").alias("updated_at"), (F.count("*") > 1).alias("replaced"))


def latest_status(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, status) after all events; unknown ids are skipped, pairs without events keep their status."""
    last = events.join(pairs.select("id"), "id", "left_semi").groupBy("id").agg(F.max_by("status", F.struct("event_time", "event_id")).alias("new"))
    return pairs.join(last, "id", "left").withColumn("status", F.coalesce("new", "status")).drop("new")


def checked_labels(labels: DataFrame, pooled: DataFrame, assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound labels, and the others with a reason."""
    marked = labels.join(pooled.select("query_id", "doc_id").distinct().withColumn("in_pool", F.lit(True)), ["query_id", "doc_id"], "left").join(assigned.select("annotator_id", "query_id").distinct().withColumn("own", F.lit(True)), ["annotator_id", "query_id"], "left")
    reason = F.when(F.col("label").isNull() | ~F.col("label").between(0, 2), "label").when(F.col("own").isNull(), "not assigned").when(F.col("in_pool").isNull(), "not in the pool")
    marked = marked.withColumn("reason", reason).drop("in_pool", "own")
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def clamped(index: Column, total: Column) -> Column:
    """A position within [0, total - 1]; 0 for no items."""
    return F.greatest(F.lit(0), F.least(index, total - 1))


def progress(assigned: DataFrame, pooled: DataFrame, labels: DataFrame, positions: DataFrame) -> DataFrame:
    """(annotator_id, query_id, total, graded, position) of each assignment."""
    totals = pooled.groupBy("query_id").agg(F.count("*").alias("total"))
    done = labels.join(pooled, ["query_id", "doc_id"], "left_semi").groupBy("annotator_id", "query_id").agg(F.count_distinct("doc_id").alias("graded"))
    last = positions.groupBy("annotator_id", "query_id").agg(F.max_by("current_index", "event_time").alias("at"))
    out = assigned.join(totals, "query_id", "left").join(done, ["annotator_id", "query_id"], "left").join(last, ["annotator_id", "query_id"], "left")
    zero = F.lit(0)
    return out.select("annotator_id", "query_id", F.coalesce("total", zero).alias("total"), F.coalesce("graded", zero).alias("graded"), clamped(F.coalesce("at", zero), F.coalesce("total", zero)).alias("position"))


def sheet(assigned: DataFrame, pooled: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What an annotator sees: pooled documents, their texts and the own labels."""
    rows = assigned.join(pooled, "query_id").join(docs.select("doc_id", "text"), "doc_id", "left").join(labels.select("annotator_id", "query_id", "doc_id", "label"), ["annotator_id", "query_id", "doc_id"], "left")
    return rows.select("annotator_id", "query_id", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")


def common_docs(labels: DataFrame, pooled: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id) that every annotator of the query has labelled."""
    n = labels.groupBy("query_id").agg(F.count_distinct("annotator_id").alias("n"))
    got = labels.groupBy("query_id", "doc_id").agg(F.count_distinct("annotator_id").alias("m")).join(n, "query_id").filter("m = n").select("query_id", "doc_id")
    return got if pooled is None else got.join(pooled, ["query_id", "doc_id"], "left_semi")


def _pairs(labels: DataFrame) -> DataFrame:
    a, b = labels.select("query_id", "doc_id", F.col("annotator_id").alias("a"), F.col("label").alias("x")), labels.select("query_id", "doc_id", F.col("annotator_id").alias("b"), F.col("label").alias("y"))
    return a.join(b, ["query_id", "doc_id"]).filter("a < b")


def contingency(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, cells): how often each pair of labels stands in each group; pairs without a label don't count."""
    return pairs.filter("x is not null and y is not null").groupBy(*keys, "x", "y").agg(F.count("*").alias("cells"))


def _kappa_of(table: DataFrame, keys: list[str], labels: int) -> DataFrame:
    c = F.col("cells")
    at = lambda when: F.coalesce(F.sum(F.when(when, c)), F.lit(0))
    each = [at(F.col(side) == i).alias(f"{side}{i}") for side in "xy" for i in range(labels)]
    g = table.groupBy(*keys).agg(F.sum(c).alias("n"), at(F.col("x") == F.col("y")).alias("same"), *each)
    chance = sum((F.col(f"x{i}") * F.col(f"y{i}") for i in range(labels)), F.lit(0)) / (F.col("n") * F.col("n"))
    return g.select(*keys, "n", (F.col("same") / F.col("n")).alias("agreement"), F.try_divide(F.col("same") / F.col("n") - chance, 1 - chance).alias("kappa"))


def _spearman_of(table: DataFrame, keys: list[str]) -> DataFrame:
    def ranked(side: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(side)  # one row a label
        m = table.groupBy(*keys, side).agg(F.sum("cells").alias("own"))
        return m.select(*keys, side, (F.sum("own").over(order) - (F.col("own") - 1) / 2).alias(f"r{side}"))

    c = F.col("cells")
    mean = lambda of: F.sum(c * of) / F.sum(c)
    rx, ry = F.col("rx"), F.col("ry")
    cov = mean(rx * ry) - mean(rx) * mean(ry)
    spread = (mean(rx * rx) - mean(rx) * mean(rx)) * (mean(ry * ry) - mean(ry) * mean(ry))
    both = table.join(ranked("x"), [*keys, "x"]).join(ranked("y"), [*keys, "y"])
    return both.groupBy(*keys).agg(F.when(spread > 1e-12, cov / F.sqrt(spread)).alias("rho"), F.sum(c).alias("n_ranked"))


def kappa(pairs: DataFrame, keys: list[str], labels: int = 3) -> DataFrame:
    """Cohen's kappa of (x, y) labels for each group; null where chance agreement is 1."""
    return _kappa_of(contingency(pairs, keys), keys, labels)


def spearman(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rank correlation with average ranks of (x, y) for each group; null for constant labels.

    Ranks follow from the counts of labels: no task sees a group's pairs.
    """
    return _spearman_of(contingency(pairs, keys), keys)


def agreement(labels: DataFrame, pooled: DataFrame | None = None) -> DataFrame:
    """(query_id, annotators, common, kappa, spearman, raw): null with under two annotators or common documents."""
    who = labels.groupBy("query_id").agg(F.count_distinct("annotator_id").alias("annotators"))
    common = common_docs(labels, pooled)
    own = labels.join(common, ["query_id", "doc_id"], "left_semi")
    raw = own.groupBy("query_id", "doc_id").agg((F.count_distinct("label") == 1).cast("int").alias("same")).groupBy("query_id").agg(F.count("*").alias("common"), F.avg("same").alias("raw"))
    pairs = _pairs(own)
    k = kappa(pairs, ["query_id", "a", "b"]).groupBy("query_id").agg(F.avg("kappa").alias("kappa"))
    s = spearman(pairs, ["query_id", "a", "b"]).groupBy("query_id").agg(F.avg("rho").alias("spearman"))
    ok = (F.col("annotators") >= 2) & (F.col("common") >= 2)
    out = who.join(raw, "query_id", "left").join(k, "query_id", "left").join(s, "query_id", "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return out.select("query_id", "annotators", "common", *[F.when(ok, F.round(c, 4)).alias(c) for c in ("kappa", "spearman", "raw")])


def overall(summary: DataFrame) -> DataFrame:
    return summary.agg(F.round(F.avg("kappa"), 4).alias("mean_kappa"), F.round(F.avg("spearman"), 4).alias("mean_spearman"), F.count("kappa").alias("queries_with_agreement"), F.count("*").alias("total_queries"))


def bands(c: Column) -> Column:
    """Words for a kappa."""
    out = F.when(c.isNull(), "N/A").when(c < 0, "Less than chance agreement")
    for edge, word in ((0.2, "Slight"), (0.4, "Fair"), (0.6, "Moderate"), (0.8, "Substantial")):
        out = out.when(c < edge, f"{word} agreement")
    return out.otherwise("Almost perfect agreement")


def validation(human: DataFrame, model: DataFrame, labels: int = 3) -> DataFrame:
    """Agreement of two judgment tables (query_id, doc_id, grade) by query and overall (query_id ALL).

    Pairs are counted by query once; the overall table is the sum of these counts.
    """
    pairs = human.select("query_id", "doc_id", F.col("grade").alias("x")).join(model.select("query_id", "doc_id", F.col("grade").alias("y")), ["query_id", "doc_id"])
    own = contingency(pairs.select(F.col("query_id").cast("string").alias("query_id"), "x", "y"), ["query_id"])
    both = own.unionByName(own.groupBy("x", "y").agg(F.sum("cells").alias("cells")).withColumn("query_id", F.lit("ALL")))
    out = _kappa_of(both, ["query_id"], labels).join(_spearman_of(both, ["query_id"]), "query_id")
    return out.select("query_id", "n", F.round("agreement", 4).alias("agreement"), F.round("kappa", 4).alias("kappa"), F.round("rho", 4).alias("spearman"), bands(F.round("kappa", 4)).alias("band"))


def distribution(judged: DataFrame) -> DataFrame:
    """(grade, n, percent)."""
    n = judged.groupBy("grade").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(judged.agg(F.count("*").alias("t")))).select("grade", "n", F.round(100.0 * F.col("n") / F.col("t"), 1).alias("percent"))


def adjudicated(labels: DataFrame) -> DataFrame:
    """(query_id, doc_id, label): the label of most annotators, null if no label has more than half."""
    votes = labels.groupBy("query_id", "doc_id", "label").agg(F.count("*").alias("v"))
    return votes.groupBy("query_id", "doc_id").agg(F.max_by(F.struct("label", "v"), F.struct("v", -F.col("label"))).alias("b"), F.sum("v").alias("n")).select("query_id", "doc_id", F.when(F.col("b.v") * 2 > F.col("n"), F.col("b.label")).alias("label"))


def prompts(pairs: DataFrame, template: str = "Question: %s\nPassage: %s\nGrade (0, 1 or 2):") -> DataFrame:
    return pairs.withColumn("prompt", F.format_string(template, "query", "text"))


def parsed_grade(answer: Column) -> Column:
    """The first digit from 0 to 2 of an answer, else null."""
    found = F.regexp_extract(F.coalesce(answer, F.lit("")), "([012])", 1)
    return F.when(found != "", found.cast("int"))


def graded(pairs: DataFrame, done: DataFrame, factory: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """Grades of (query_id, doc_id, query, text) by a user's model; pairs graded before are skipped."""
    todo = prompts(pairs.join(done.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")).select("query_id", "doc_id", "prompt")
    kinds = dict(todo.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            yield pd.DataFrame({"query_id": pdf["query_id"], "doc_id": pdf["doc_id"], "answer": model(pdf["prompt"].tolist())})

    answers = todo.mapInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, answer string")
    return answers.select("query_id", "doc_id", parsed_grade(F.col("answer")).alias("grade"))


FIELDS = ("concept_en", "concept_ar", "entity_en", "entity_ar")


def parsed_pairs(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Pairs of four non-empty fields from answers with a JSON array, in a code fence or not."""
    body = F.regexp_extract(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*|\s*```$", ""), r"(?s)(\[.*\])", 1)
    kind = "array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">>"
    rows = answers.withColumn("p", F.explode(F.from_json(body, kind)))
    out = rows.select(*[c for c in answers.columns if c != answer], *[F.trim(F.coalesce(f"p.{f}", F.lit(""))).alias(f) for f in FIELDS])
    for f in FIELDS:
        out = out.filter(F.col(f) != "")
    return out


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(kind, value, n): by status, by topic and in total, in one pass."""
    g = pairs.groupingSets([[F.col("status")], [F.col("topic")], []], "status", "topic").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return g.select(F.when(F.col("g") == 1, "status").when(F.col("g") == 2, "topic").otherwise("total").alias("kind"), F.when(F.col("g") == 1, F.col("status")).when(F.col("g") == 2, F.col("topic")).otherwise("").alias("value"), "n")


def verified_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    return pairs.filter("status = 'verified'").join(docs.select("doc_id", "text"), "doc_id")


def searched_pairs(pairs: DataFrame, part: str, status: str | None, offset: int, limit: int) -> DataFrame:
    """A page of pairs whose topic holds a text, by id, with the total number of matches."""
    hits = pairs.filter(F.contains(F.lower("topic"), F.lit(part.lower())))
    hits = hits if status is None else hits.filter(F.col("status") == status)
    return hits.orderBy("id").offset(offset).limit(limit).join(F.broadcast(hits.agg(F.count("*").alias("total"))))
