"""Queries of pools, judgments, metrics, tests, training pairs and logs (A, M, X, G, P16-P18, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dense as de
from ..operators import judgments as ju
from ..operators import logs as lo
from ..operators import metrics as me
from ..operators import stats as st
from ..operators import training as tr
from ..sources import store
from ..streaming import logs as live
from .base import EVENTS, LOG, PAIRS, QRELS, label_events, pairs, qrels, query, request_log, table
from .ranking import RUN, SYSTEMS, WHOLE_RUN, deep_run, run, whole_run


def _q(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("a01_pool", f"WITH {WHOLE_RUN} SELECT DISTINCT query_id, doc_id FROM run")
def _(s, d):
    return ju.pool(whole_run(s, d))


@query("a02_pool_manifest", f"""WITH {RUN}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id, doc_id) AS n FROM run)
SELECT n.query_id, system, count(*) AS contributed, count(*) FILTER (n = 1) AS unique_docs, any_value(pool_size) AS pool_size FROM n JOIN (SELECT query_id, count(DISTINCT doc_id) AS pool_size FROM run GROUP BY query_id) p ON p.query_id = n.query_id GROUP BY n.query_id, system""")
def _(s, d):
    return ju.pool_manifest(run(s, d))


@query("a03_missing_runs", f"WITH {RUN} SELECT s.system, item_id AS query_id FROM (VALUES ('bm25'), ('tfidf'), ('dense')) s(system), benchmark WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.system = s.system AND r.query_id = item_id)")
def _(s, d):
    return ju.missing_runs(run(s, d), s.sql("SELECT * FROM VALUES ('bm25'), ('tfidf'), ('dense') AS t(system)"), _q(s, d))


TRAINING = ["bm25", "tfidf", "cosine", "bm25_prf"]


@query("a04_training_pool", f"WITH {WHOLE_RUN} SELECT DISTINCT query_id, doc_id FROM deep WHERE system IN {tuple(TRAINING)}")
def _(s, d):
    return ju.pool(deep_run(s, d).filter(F.col("system").isin(TRAINING)), 100)


@query("a05_assignment", """WITH q AS (SELECT item_id AS query_id, row_number() OVER (ORDER BY item_id) - 1 AS q, count(*) OVER () AS n FROM benchmark),
sl AS (SELECT query_id, (l * n + q) // 2 AS seat FROM q, range(3) t(l)), a AS (SELECT c_custkey AS annotator_id, row_number() OVER (ORDER BY c_custkey) - 1 AS seat FROM customer)
SELECT annotator_id, query_id FROM sl JOIN a USING (seat)""")
def _(s, d):
    who = table(s, d, "customer").select(F.col("c_custkey").alias("annotator_id"), F.col("c_custkey").alias("signed_up"))
    return ju.dealt(who, _q(s, d))


_SEATS = "CAST(item_id * 7 % 4 AS BIGINT)"
_FREE = "list_transform(list_filter(s, lambda x: x.n < 3)[1:2], lambda x: x.q)"


@query("a05_seats_on_top", f"""WITH RECURSIVE st AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS got, (SELECT list({{'n': {_SEATS}, 'q': item_id}} ORDER BY {_SEATS}, item_id) FROM benchmark) AS s
UNION ALL SELECT i + 1, {_FREE}, list_sort(list_transform(s, lambda x: {{'n': x.n + CAST(list_contains({_FREE}, x.q) AS BIGINT), 'q': x.q}})) FROM st WHERE i < (SELECT count(*) FROM customer) AND len({_FREE}) > 0),
a AS (SELECT c_custkey AS annotator_id, row_number() OVER (ORDER BY c_custkey) AS i FROM customer)
SELECT annotator_id, unnest(got) AS query_id FROM st JOIN a USING (i)""")
def _(s, d):
    """The sequential rule from uneven seats."""
    who = table(s, d, "customer").select(F.col("c_custkey").alias("annotator_id"), F.col("c_custkey").alias("signed_up"))
    taken = _q(s, d).select("query_id", (F.col("query_id") * 7 % 4).alias("seats"))
    return ju.dealt(who, _q(s, d), taken=taken)


LABELS = f"{EVENTS}, lab AS MATERIALIZED (SELECT annotator_id, query_id, doc_id, arg_max(label, (event_time, event_id)) AS label, max(event_time) AS updated_at, count(*) > 1 AS replaced FROM ev GROUP BY ALL)"


def labels(s, d):
    return ju.latest_labels(label_events(s, d))


@query("a06_latest_labels", f"WITH {LABELS} SELECT annotator_id, query_id, doc_id, label, replaced FROM lab")
def _(s, d):
    return labels(s, d).select("annotator_id", "query_id", "doc_id", "label", "replaced")


_POOLED = "pooled AS (SELECT DISTINCT query_id, doc_id FROM ev), assigned AS (SELECT DISTINCT annotator_id, query_id FROM ev)"


def _pooled(s, d):
    e = label_events(s, d)
    return e.select("query_id", "doc_id").distinct(), e.select("annotator_id", "query_id").distinct()


_NARROW = "pooled AS (SELECT DISTINCT query_id, doc_id FROM ev SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') USING (doc_id)), assigned AS (SELECT DISTINCT annotator_id, query_id FROM ev WHERE query_id <> 'error')"


def _narrow(s, d):
    """A pool of English documents only, and no assignments to one query: leaves labels to reject."""
    e = label_events(s, d)
    english = table(s, d, "documents").filter("lang = 'en'").select("doc_id")
    return e.join(english, "doc_id", "left_semi").select("query_id", "doc_id").distinct(), e.filter("query_id <> 'error'").select("annotator_id", "query_id").distinct()


_POS = "pos AS (SELECT annotator_id, query_id, arg_max(i, event_time) AS i FROM (SELECT annotator_id, query_id, CAST(event_id % 60 AS INT) AS i, event_time FROM ev WHERE query_id <> 'view') GROUP BY ALL)"


@query("a07_progress", f"""WITH {LABELS}, {_POOLED}, {_POS}, t AS (SELECT query_id, count(*) AS total FROM pooled GROUP BY query_id), g AS (SELECT annotator_id, query_id, count(DISTINCT doc_id) AS graded FROM lab SEMI JOIN pooled USING (query_id, doc_id) GROUP BY ALL)
SELECT annotator_id, query_id, coalesce(total, 0) AS total, coalesce(graded, 0) AS graded, greatest(0, least(coalesce(i, 0), coalesce(total, 0) - 1)) AS position FROM assigned LEFT JOIN t USING (query_id) LEFT JOIN g USING (annotator_id, query_id) LEFT JOIN pos USING (annotator_id, query_id)""")
def _(s, d):
    pooled, assigned = _pooled(s, d)
    at = label_events(s, d).filter("query_id <> 'view'").select("annotator_id", "query_id", (F.col("event_id") % 60).cast("int").alias("current_index"), "event_time")
    return ju.progress(assigned, pooled, labels(s, d), at)


@query("a08_sheet", f"WITH {LABELS}, {_POOLED} SELECT a.annotator_id, a.query_id, p.doc_id, coalesce(text, '') AS text, label FROM assigned a JOIN pooled p ON p.query_id = a.query_id LEFT JOIN documents d ON d.doc_id = p.doc_id LEFT JOIN lab ON lab.annotator_id = a.annotator_id AND lab.query_id = a.query_id AND lab.doc_id = p.doc_id")
def _(s, d):
    pooled, assigned = _pooled(s, d)
    return ju.sheet(assigned, pooled, table(s, d, "documents"), labels(s, d))


_COMMON = "common AS MATERIALIZED (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, count(DISTINCT annotator_id) AS m FROM lab GROUP BY ALL) JOIN (SELECT query_id, count(DISTINCT annotator_id) AS n FROM lab GROUP BY ALL) USING (query_id) WHERE m = n)"


@query("a09_common_documents", f"WITH {LABELS}, {_POOLED}, {_COMMON} SELECT query_id, doc_id FROM common SEMI JOIN pooled USING (query_id, doc_id)")
def _(s, d):
    return ju.common_docs(labels(s, d), _pooled(s, d)[0])


_PAIR = "own AS MATERIALIZED (SELECT * FROM lab SEMI JOIN common USING (query_id, doc_id)), pr AS MATERIALIZED (SELECT x.query_id, x.annotator_id AS a, y.annotator_id AS b, x.label AS x, y.label AS y FROM own x JOIN own y ON x.query_id = y.query_id AND x.doc_id = y.doc_id AND x.annotator_id < y.annotator_id)"


def _kappa(keys: str, source: str) -> str:
    chance = " + ".join(f"count(*) FILTER (x = {i}) * count(*) FILTER (y = {i})" for i in range(3))
    return f"(SELECT {keys}, n, po AS agreement, (po - pe) / nullif(1 - pe, 0) AS kappa FROM (SELECT {keys}, count(*) AS n, count(*) FILTER (x = y) / count(*) AS po, ({chance}) / (count(*) * count(*)) AS pe FROM {source} GROUP BY {keys}))"


def _rho(keys: str, source: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2"
    return f"(SELECT {keys}, CASE WHEN var_pop(rx) * var_pop(ry) > 1e-12 THEN covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END AS rho FROM (SELECT *, {rank('x')} AS rx, {rank('y')} AS ry FROM {source}) GROUP BY {keys})"


@query("a10_kappa_pairs", f"WITH {LABELS}, {_COMMON}, {_PAIR} SELECT query_id, a, b, n, round(kappa, 6) AS kappa FROM {_kappa('query_id, a, b', 'pr')}")
def _(s, d):
    own = labels(s, d)
    p = ju._pairs(own.join(ju.common_docs(own), ["query_id", "doc_id"], "left_semi"))
    return ju.kappa(p, ["query_id", "a", "b"]).select("query_id", "a", "b", "n", F.round("kappa", 6).alias("kappa"))


@query("a11_spearman_pairs", f"WITH {LABELS}, {_COMMON}, {_PAIR} SELECT query_id, a, b, round(rho, 6) AS rho FROM {_rho('query_id, a, b', 'pr')}")
def _(s, d):
    own = labels(s, d)
    p = ju._pairs(own.join(ju.common_docs(own), ["query_id", "doc_id"], "left_semi"))
    return ju.spearman(p, ["query_id", "a", "b"]).select("query_id", "a", "b", F.round("rho", 6).alias("rho"))


AGREE = f"""{LABELS}, {_COMMON}, {_PAIR},
agree AS MATERIALIZED (SELECT w.query_id, annotators, coalesce(common, 0) AS common, CASE WHEN ok THEN round(kappa, 4) END AS kappa, CASE WHEN ok THEN round(spearman, 4) END AS spearman, CASE WHEN ok THEN round(raw, 4) END AS raw FROM (
  SELECT *, annotators >= 2 AND common >= 2 AS ok FROM (SELECT query_id, count(DISTINCT annotator_id) AS annotators FROM lab GROUP BY ALL)
  LEFT JOIN (SELECT query_id, count(*) AS common, avg(same) AS raw FROM (SELECT query_id, doc_id, CAST(count(DISTINCT label) = 1 AS INT) AS same FROM own GROUP BY ALL) GROUP BY query_id) USING (query_id)
  LEFT JOIN (SELECT query_id, avg(kappa) AS kappa FROM {_kappa('query_id, a, b', 'pr')} GROUP BY query_id) USING (query_id)
  LEFT JOIN (SELECT query_id, avg(rho) AS spearman FROM {_rho('query_id, a, b', 'pr')} GROUP BY query_id) USING (query_id)) w)"""


@query("a12_agreement", f"WITH {AGREE} SELECT * FROM agree")
def _(s, d):
    return ju.agreement(labels(s, d))


@query("a13_overall_agreement", f"WITH {AGREE} SELECT round(avg(kappa), 4) AS mean_kappa, round(avg(spearman), 4) AS mean_spearman, count(kappa) AS queries_with_agreement, count(*) AS total_queries FROM agree")
def _(s, d):
    return ju.overall(ju.agreement(labels(s, d)))


_BAND = "CASE WHEN k IS NULL THEN 'N/A' WHEN k < 0 THEN 'Less than chance agreement' WHEN k < 0.2 THEN 'Slight agreement' WHEN k < 0.4 THEN 'Fair agreement' WHEN k < 0.6 THEN 'Moderate agreement' WHEN k < 0.8 THEN 'Substantial agreement' ELSE 'Almost perfect agreement' END"
_GM = f"{EVENTS}, vp AS (SELECT CAST(query_id AS VARCHAR) AS query_id, x.label AS x, y.label AS y FROM (SELECT query_id, doc_id, CAST(max(label) AS INT) AS label FROM ev WHERE annotator_id = 0 GROUP BY ALL) x JOIN (SELECT query_id, doc_id, CAST(min(label) AS INT) AS label FROM ev WHERE annotator_id = 1 GROUP BY ALL) y USING (query_id, doc_id)), vb AS MATERIALIZED (SELECT * FROM vp UNION ALL SELECT 'ALL', x, y FROM vp)"


def _graders(s, d):
    e = label_events(s, d)
    return [e.filter(F.col("annotator_id") == i).groupBy("query_id", "doc_id").agg(f("label").alias("grade")) for i, f in ((0, F.max), (1, F.min))]


@query("a14_grader_validation", f"WITH {_GM} SELECT query_id, n, round(agreement, 4) AS agreement, k AS kappa, round(rho, 4) AS spearman, {_BAND} AS band FROM (SELECT *, round(kappa, 4) AS k FROM {_kappa('query_id', 'vb')}) JOIN {_rho('query_id', 'vb')} USING (query_id)")
def _(s, d):
    return ju.validation(*_graders(s, d))


@query("a14_grade_distribution", f"WITH {EVENTS}, g AS (SELECT query_id, doc_id, CAST(max(label) AS INT) AS grade FROM ev WHERE annotator_id = 0 GROUP BY ALL) SELECT grade, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM g), 1)::DOUBLE AS percent FROM g GROUP BY grade")
def _(s, d):
    return ju.distribution(_graders(s, d)[0])


@query("a15_kappa_bands", f"WITH {AGREE} SELECT query_id, {_BAND.replace(' k ', ' kappa ')} AS band FROM agree")
def _(s, d):
    return ju.agreement(labels(s, d)).select("query_id", ju.bands(F.col("kappa")).alias("band"))


@query("a16_adjudicated", f"WITH {LABELS}, v AS (SELECT query_id, doc_id, label, count(*) AS v FROM lab GROUP BY ALL) SELECT query_id, doc_id, CASE WHEN max(v) * 2 > sum(v) THEN arg_max(label, (v, -label)) END AS label FROM v GROUP BY ALL")
def _(s, d):
    return ju.adjudicated(labels(s, d))


@query("a17_parsed_grades", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(2 AS INT) WHEN 1 THEN CAST(0 AS INT) WHEN 2 THEN CAST(1 AS INT) END AS grade FROM documents")
def _(s, d):
    answer = F.element_at(F.array(F.lit("Grade: 2, not 1"), F.lit("0"), F.lit("I say 9 or 1."), F.lit("none")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(s, d, "documents").select("doc_id", ju.parsed_grade(answer).alias("grade"))


@query("a17_grades_in_texts", "SELECT doc_id, CAST(nullif(regexp_extract(coalesce(text, ''), '[012]'), '') AS INT) AS grade FROM documents")
def _(s, d):
    """Whole texts as a model's answers."""
    return table(s, d, "documents").select("doc_id", ju.parsed_grade(F.col("text")).alias("grade"))


def toy_model():
    """Stands for a user's grading model: answers by the length of the prompt."""
    return lambda prompts: [f"Grade {len(p) % 3}" for p in prompts]


@query("a17_model_grades", f"WITH {WHOLE_RUN}, {QRELS} SELECT p.query_id, p.doc_id, CAST((len(b.text) + len(d.text) + 39) % 3 AS INT) AS grade FROM (SELECT DISTINCT query_id, doc_id FROM run WHERE rank <= 10) p JOIN benchmark b ON b.item_id = p.query_id JOIN documents d ON d.doc_id = p.doc_id WHERE NOT EXISTS (SELECT 1 FROM qrels q WHERE q.query_id = p.query_id AND q.doc_id = p.doc_id)")
def _(s, d):
    pool = ju.pool(whole_run(s, d), 10).join(_q(s, d).withColumnRenamed("text", "query"), "query_id").join(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    return ju.graded(pool, qrels(s, d), toy_model)


@query("a18_generated_pairs", "SELECT doc_id, 'a' || doc_id AS concept_en, 'b' AS concept_ar, 'c' AS entity_en, 'd' AS entity_ar FROM documents WHERE doc_id % 3 <> 1")
def _(s, d):
    one = lambda ar: F.concat(F.lit('{"concept_en": "a'), F.col("doc_id"), F.lit(f'", "concept_ar": "{ar}", "entity_en": " c ", "entity_ar": "d"}}'))
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n["), one("b"), F.lit(", "), one(""), F.lit("]\n```"))).when(F.col("doc_id") % 3 == 1, F.lit("no pairs")).otherwise(F.concat(F.lit("Here: ["), one("b"), F.lit("] done")))
    return ju.parsed_pairs(table(s, d, "documents").select("doc_id", answer.alias("answer")))


_FOUR = ", ".join(f"trim(coalesce(split_part(text, ' ', {i + 1}), '')) AS {f}" for i, f in enumerate(ju.FIELDS))


@query("a18_pairs_from_texts", f"SELECT * FROM (SELECT doc_id, {_FOUR} FROM documents) WHERE {' AND '.join(f + chr(60) + chr(62) + chr(39) * 2 for f in ju.FIELDS)}")
def _(s, d):
    """The first four words of each text as an answer in JSON, with all the characters that JSON escapes; empty fields drop the pair."""
    fields = [F.coalesce(F.split_part("text", F.lit(" "), F.lit(i + 1)), F.lit("")).alias(f) for i, f in enumerate(ju.FIELDS)]
    answer = F.concat(F.lit("```json\n"), F.to_json(F.array(F.struct(*fields))), F.lit("\n```"))
    return ju.parsed_pairs(table(s, d, "documents").select("doc_id", answer.alias("answer")))


_STATUS = f"{PAIRS}, se AS (SELECT event_id, ts AS event_time, event_id % 1200 AS id, CASE WHEN event_id % 2 = 0 THEN 'verified' ELSE 'rejected' END AS status FROM events), now AS (SELECT id, doc_id, topic, concept_en, concept_ar, coalesce(n.status, pairs.status) AS status FROM pairs LEFT JOIN (SELECT id, arg_max(status, (event_time, event_id)) AS status FROM se GROUP BY id) n USING (id))"


def _status(s, d):
    e = table(s, d, "events").selectExpr("event_id", "ts AS event_time", "event_id % 1200 AS id", "CASE WHEN event_id % 2 = 0 THEN 'verified' ELSE 'rejected' END AS status")
    return ju.latest_status(e, pairs(s, d))


@query("a19_pair_status", f"WITH {_STATUS} SELECT id, status FROM now")
def _(s, d):
    return _status(s, d).select("id", "status")


@query("a20_pair_counts", f"WITH {_STATUS} SELECT 'status' AS kind, status AS value, count(*) AS n FROM now GROUP BY status UNION ALL SELECT 'topic', topic, count(*) FROM now GROUP BY topic UNION ALL SELECT 'total', '', count(*) FROM now")
def _(s, d):
    return ju.pair_counts(_status(s, d))


@query("a21_verified_pairs", f"WITH {_STATUS} SELECT now.id, topic, text FROM now JOIN documents d ON d.doc_id = now.doc_id WHERE status = 'verified'")
def _(s, d):
    return ju.verified_pairs(_status(s, d), table(s, d, "documents")).select("id", "topic", "text")


@query("p16_pair_search", f"WITH {PAIRS}, h AS (SELECT * FROM pairs WHERE contains(lower(topic), 'ic 3') AND status = 'verified') SELECT id, topic, status, (SELECT count(*) FROM h) AS total FROM h ORDER BY id LIMIT 10 OFFSET 5")
def _(s, d):
    return ju.searched_pairs(pairs(s, d), "IC 3", "verified", 5, 10).select("id", "topic", "status", "total")


@query("p17_clamped_progress", "SELECT event_id, greatest(CAST(0 AS BIGINT), least(event_id % 9 - 1, event_id % 5 - 1)) AS position FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", ju.clamped(F.col("event_id") % 9 - 1, F.col("event_id") % 5).alias("position"))


@query("p18_checked_labels", f"""WITH {EVENTS}, {_NARROW}, x AS (SELECT e.event_id, CASE WHEN e.label = 2 AND e.event_id % 7 = 0 THEN 'label' WHEN a.annotator_id IS NULL THEN 'not assigned' WHEN p.doc_id IS NULL THEN 'not in the pool' END AS reason
  FROM ev e LEFT JOIN pooled p ON p.query_id = e.query_id AND p.doc_id = e.doc_id LEFT JOIN assigned a ON a.annotator_id = e.annotator_id AND a.query_id = e.query_id) SELECT event_id, coalesce(reason, '') AS reason FROM x""")
def _(s, d):
    e = label_events(s, d).withColumn("label", F.when((F.col("label") == 2) & (F.col("event_id") % 7 == 0), 5).otherwise(F.col("label")))
    good, bad = ju.checked_labels(e, *_narrow(s, d))
    return good.select("event_id", F.lit("").alias("reason")).unionByName(bad.select("event_id", "reason"))


def _metric_sql() -> str:
    gain = "(pow(2.0, grade) - 1)"
    cuts = (5, 10)
    sums = ", ".join(f"sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) AS hits_{k}, sum(CASE WHEN rank <= {k} THEN {gain} / log2(rank + 1.0) END) AS dcg_{k}" for k in cuts)
    ideal = ", ".join(f"sum(CASE WHEN r <= {k} THEN {gain} / log2(r + 1.0) END) AS idcg_{k}" for k in cuts)
    z = lambda a, b: f"coalesce(({a}) / nullif({b}, 0), 0.0)"
    f = lambda p, r, q=1: z(f"{1 + q * q} * {p} * {r}", f"{q * q} * {p} + {r}")
    p, r = z("hits", "n_ret"), z("hits", "n_rel")
    cols = {"precision": p, "recall": r, "f1": f(p, r), "f2": f(p, r, 2), "ap": z("coalesce(ap, 0)", "n_rel"), "rr": "coalesce(1.0 / first, 0.0)", "jaccard": z("hits", "n_ret + n_rel - hits"), "dcg": "coalesce(dcg, 0.0)", "ndcg": z("coalesce(dcg, 0)", "idcg")}
    for k in cuts:
        pk, rk_ = f"(hits_{k} / {k})", z(f"hits_{k}", "n_rel")
        cols |= {f"p_{k}": pk, f"r_{k}": rk_, f"f1_{k}": f(pk, rk_), f"jaccard_{k}": z(f"hits_{k}", f"least({k}, n_ret) + n_rel - hits_{k}"), f"ndcg_{k}": z(f"coalesce(dcg_{k}, 0)", f"idcg_{k}"), f"capped_{k}": z(f"hits_{k}", f"least({k}, n_rel)")}
    return f"""hit AS (SELECT system, run.query_id, run.doc_id, rank, coalesce(grade, 0) AS grade, CAST(coalesce(grade, 0) > 0 AS INT) AS rel FROM run LEFT JOIN qrels USING (query_id, doc_id)),
hs AS (SELECT *, sum(rel) OVER (PARTITION BY system, query_id ORDER BY rank) AS seen FROM hit),
sm AS (SELECT system, query_id, count(*) AS n_ret, sum(rel) AS hits, sum(CASE WHEN rel = 1 THEN seen / rank END) AS ap, min(CASE WHEN rel = 1 THEN rank END) AS first, sum({gain} / log2(rank + 1.0)) AS dcg, {sums} FROM hs GROUP BY ALL),
id AS (SELECT query_id, count(*) FILTER (grade > 0) AS n_rel, sum({gain} / log2(r + 1.0)) AS idcg, {ideal} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM qrels) GROUP BY query_id),
raw AS MATERIALIZED (SELECT system, query_id, {', '.join(f'{c} AS {n}' for n, c in cols.items())} FROM sm JOIN id USING (query_id)),
met AS (SELECT system, query_id, {', '.join(f'round({n}, 6) AS {n}' for n in cols)} FROM raw)"""


METRICS = f"{RUN}, {QRELS}, {_metric_sql()}"
WHOLE_METRICS = f"{WHOLE_RUN}, {QRELS}, {_metric_sql()}"
_NAMES = ["precision", "recall", "f1", "f2", "ap", "rr", "jaccard", "dcg", "ndcg"] + [f"{m}_{k}" for k in (5, 10) for m in ("p", "r", "f1", "jaccard", "ndcg", "capped")]
_LM = f"lm AS MATERIALIZED (SELECT system, query_id, metric, value FROM raw UNPIVOT (value FOR metric IN ({', '.join(_NAMES)})))"
LONG, WHOLE_LONG = f"{METRICS}, {_LM}", f"{WHOLE_METRICS}, {_LM}"


_metrics: dict[tuple, DataFrame] = {}


def metrics(s, d, rows=run):
    """Of a run table, unrounded: means and tests come from these, each rounded once. Written once for each session, folder and run."""
    key = (s.sparkContext.applicationId, d, rows)
    if key not in _metrics:
        _metrics[key] = store.stored(me.per_query(rows(s, d), qrels(s, d), digits=None))
    return _metrics[key]


def long(s, d, rows=run):
    return me.long(metrics(s, d, rows))


@query("m01_set_metrics", f"WITH {METRICS} SELECT system, query_id, precision, recall, f1, f2, jaccard FROM met")
def _(s, d):
    return me.rounded(metrics(s, d)).select("system", "query_id", "precision", "recall", "f1", "f2", "jaccard")


@query("m02_cutoff_metrics", f"WITH {WHOLE_METRICS} SELECT system, query_id, p_5, p_10, r_5, r_10, f1_5, f1_10, jaccard_5, jaccard_10 FROM met")
def _(s, d):
    return me.rounded(metrics(s, d, whole_run)).select("system", "query_id", "p_5", "p_10", "r_5", "r_10", "f1_5", "f1_10", "jaccard_5", "jaccard_10")


@query("m03_average_precision", f"WITH {WHOLE_METRICS} SELECT system, query_id, ap FROM met")
def _(s, d):
    return me.rounded(metrics(s, d, whole_run)).select("system", "query_id", "ap")


@query("m04_jaccard", f"WITH {WHOLE_METRICS} SELECT system, query_id, jaccard, jaccard_5, jaccard_10 FROM met")
def _(s, d):
    return me.rounded(metrics(s, d, whole_run)).select("system", "query_id", "jaccard", "jaccard_5", "jaccard_10")


@query("m05_ndcg", f"WITH {WHOLE_METRICS} SELECT system, query_id, dcg, ndcg, ndcg_5, ndcg_10 FROM met")
def _(s, d):
    return me.rounded(metrics(s, d, whole_run)).select("system", "query_id", "dcg", "ndcg", "ndcg_5", "ndcg_10")


@query("m06_reciprocal_rank", f"WITH {WHOLE_METRICS} SELECT system, query_id, rr FROM met")
def _(s, d):
    return me.rounded(metrics(s, d, whole_run)).select("system", "query_id", "rr")


@query("m07_per_query_table", f"WITH {WHOLE_METRICS} SELECT * FROM met")
def _(s, d):
    return me.rounded(metrics(s, d, whole_run))


@query("m08_system_table", f"WITH {METRICS} SELECT system, CASE WHEN grouping(query_id) = 1 THEN 'MEAN' ELSE CAST(query_id AS VARCHAR) END AS query_id, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in _NAMES) + " FROM raw GROUP BY GROUPING SETS ((system, query_id), (system))")
def _(s, d):
    return me.by_system(metrics(s, d))


@query("m09_closed_pool", f"WITH {RUN}, {QRELS} SELECT system, query_id, doc_id, CAST(row_number() OVER (PARTITION BY system, query_id ORDER BY round(score, 9) DESC, rank) AS INT) AS rank FROM run SEMI JOIN qrels USING (query_id, doc_id)")
def _(s, d):
    return me.closed_pool(run(s, d).withColumn("score", F.round("score", 9)), qrels(s, d)).select("system", "query_id", "doc_id", "rank")


@query("m10_evaluation", f"WITH {METRICS} SELECT system, count(*) AS queries, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, round(avg(ndcg_10), 6) AS ndcg_10 FROM raw GROUP BY system")
def _(s, d):
    return metrics(s, d).groupBy("system").agg(F.count("*").alias("queries"), me.mean("ap").alias("map"), me.mean("rr").alias("mrr"), me.mean("ndcg_10").alias("ndcg_10"))


@query("m11_graded_only", f"WITH {LONG} SELECT system, metric, round(avg(value), 6) AS mean, count(*) AS n FROM lm GROUP BY ALL")
def _(s, d):
    return me.graded_only(long(s, d), qrels(s, d))


_SEL = """e AS (SELECT vec_id, vec_id // 20 AS query_id, CAST(label AS DOUBLE) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sc AS (SELECT d.version, x.query_id, x.vec_id AS pos, CASE WHEN x.label = q.label THEN 2.0 WHEN abs(x.label - q.label) <= 1 THEN 1.0 ELSE 0.0 END AS label, round(list_dot_product(x.v[1:d.dim], q.v[1:d.dim]) / (sqrt(list_dot_product(x.v[1:d.dim], x.v[1:d.dim])) * sqrt(list_dot_product(q.v[1:d.dim], q.v[1:d.dim]))), 9) AS score
  FROM e x JOIN e q ON q.query_id = x.query_id AND q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id, (VALUES ('v16', 16), ('v32', 32), ('v64', 64)) d(version, dim)),
rr AS (SELECT *, row_number() OVER (PARTITION BY version, query_id ORDER BY score DESC, pos) AS r, row_number() OVER (PARTITION BY version, query_id ORDER BY label DESC, pos) AS best FROM sc),
nd AS (SELECT version, query_id, sum(CASE WHEN r <= 10 THEN label / log2(r + 1.0) END) AS a, sum(CASE WHEN best <= 10 THEN label / log2(best + 1.0) END) AS i FROM rr GROUP BY ALL),
sel AS MATERIALIZED (SELECT version, round(avg(a / i), 6) AS ndcg, count(*) AS queries FROM nd WHERE i > 0 GROUP BY version)"""


def _selection(s, d):
    """Candidates that cut vectors to 16, 32 or 64 components, judged by labels within groups of 20 vectors."""
    e = table(s, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 20).alias("query_id"), F.col("label").cast("double").alias("label"), "embedding")
    parts = []
    for dim in (16, 32, 64):
        own = e.withColumn("v", de.unit(F.col("embedding"), dim)).drop("embedding")
        q = own.filter("vec_id % 20 = 0").select("query_id", F.col("v").alias("q"), F.col("label").alias("ql"), F.col("vec_id").alias("qv"))
        gap = F.abs(F.col("label") - F.col("ql"))
        parts.append(own.join(q, "query_id").filter("vec_id <> qv").select(F.lit(f"v{dim}").alias("version"), "query_id", F.col("vec_id").alias("pos"), F.when(gap == 0, 2.0).when(gap <= 1, 1.0).otherwise(0.0).alias("label"), F.round(de.dot(F.col("v"), F.col("q")), 9).alias("score")))
    return me.selection_ndcg(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("m12_selection_ndcg", f"WITH {_SEL} SELECT * FROM sel")
def _(s, d):
    return _selection(s, d)


@query("m13_promotion_gate", f"WITH {_SEL} SELECT version, ndcg, current, ndcg - current >= 0.01 - 1e-12 AS promote FROM (SELECT *, (SELECT ndcg FROM sel WHERE version = 'v64') AS current FROM sel WHERE version <> 'v64' ORDER BY ndcg DESC, version DESC LIMIT 1)")
def _(s, d):
    return me.promoted(_selection(s, d), "v64", 0.01)


_KNOWN = """kw AS MATERIALIZED (SELECT doc_id, string_split_regex(text, '[ \\t\\n\\r\\f]+') AS w, array_to_string(string_split_regex(text, '[ \\t\\n\\r\\f]+'), ' ') AS t FROM documents),
kq AS MATERIALIZED (SELECT doc_id AS query_id, array_to_string(w[1:len(w) // 2], ' ') AS query, array_to_string(w[1:6], ' ') AS head FROM kw WHERE len(w) >= 12),
kr AS MATERIALIZED (SELECT query_id, doc_id FROM kq JOIN kw ON array_to_string(w[1:6], ' ') = head AND starts_with(t, query))"""


@query("m14_known_items", f"WITH {_KNOWN} SELECT query_id, doc_id, CAST(1 AS INT) AS grade FROM kr")
def _(s, d):
    return me.known_items(table(s, d, "documents"))[1]


@query("m15_title_queries", "SELECT DISTINCT trim(split_part(text, chr(10), 1)) AS title, doc_id FROM documents WHERE trim(split_part(text, chr(10), 1)) <> ''")
def _(s, d):
    return me.title_queries(table(s, d, "documents"), F.trim(F.substring_index("text", "\n", 1)))


@query("m16_capped_recall", f"WITH {METRICS} SELECT system, round(avg(capped_5), 6) AS capped_5, round(avg(r_5), 6) AS r_5, round(avg(capped_10), 6) AS capped_10 FROM raw GROUP BY system")
def _(s, d):
    return metrics(s, d).groupBy("system").agg(me.mean("capped_5").alias("capped_5"), me.mean("r_5").alias("r_5"), me.mean("capped_10").alias("capped_10"))


@query("x01_per_query_values", f"WITH {LONG} SELECT system, query_id, metric, round(value, 6) AS value FROM lm WHERE metric IN ('ap', 'ndcg_10')")
def _(s, d):
    return long(s, d).filter(F.col("metric").isin("ap", "ndcg_10")).withColumn("value", F.round("value", 6))


_PR = "pr AS MATERIALIZED (SELECT a.system AS a, b.system AS b, metric, a.query_id, a.value AS x, b.value AS y FROM (SELECT *, count(*) OVER (PARTITION BY system, metric) AS n FROM lm) a JOIN (SELECT *, count(*) OVER (PARTITION BY system, metric) AS n FROM lm) b USING (metric, query_id) WHERE b.system = 'bm25' AND a.system <> 'bm25' AND a.n = b.n)"
_CMP = f"{WHOLE_LONG}, {_PR}"


@query("x02_comparison_pairs", f"WITH {_CMP} SELECT a, b, metric, count(*) AS n FROM pr GROUP BY ALL")
def _(s, d):
    return st.compared(long(s, d, whole_run), "bm25").groupBy("a", "b", "metric").agg(F.count("*").alias("n"))


@query("x03_paired_t", f"WITH {_CMP}, g AS (SELECT a, b, metric, count(*) AS n, avg(x - y) AS m, stddev_samp(x - y) AS sd FROM pr GROUP BY ALL) SELECT a, b, metric, n, round(m, 9) AS mean_diff, round(CASE WHEN n >= 2 AND sd > 1e-15 THEN m / (sd / sqrt(n)) END, 6) AS t FROM g")
def _(s, d):
    t = st.t_tests(st.compared(long(s, d, whole_run), "bm25"))
    return t.select("a", "b", "metric", "n", F.round("mean_diff", 9).alias("mean_diff"), F.round("t", 6).alias("t"))


_WIL = "wd AS (SELECT a, b, metric, round(x - y, 12) AS d FROM pr), wr AS (SELECT *, rank() OVER (PARTITION BY a, b, metric, d = 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, metric, d = 0, abs(d)) - 1) / 2 AS r FROM wd)"


@query("x04_wilcoxon", f"WITH {_CMP}, {_WIL} SELECT a, b, metric, count(*) AS n, CASE WHEN count(*) FILTER (d <> 0) > 0 AND count(*) >= 2 THEN least(coalesce(sum(r) FILTER (d > 0), 0.0), coalesce(sum(r) FILTER (d < 0), 0.0)) END AS w FROM wr GROUP BY ALL")
def _(s, d):
    return st.wilcoxon_tests(st.compared(long(s, d, whole_run), "bm25")).select("a", "b", "metric", "n", "w")


_BOOT = """bv AS MATERIALIZED (SELECT system, metric, CAST(round(value * 1000000) AS BIGINT) AS v, value, row_number() OVER (PARTITION BY system, metric ORDER BY query_id) - 1 AS spot, count(*) OVER (PARTITION BY system, metric) AS n FROM lm),
bd AS MATERIALIZED (SELECT n, r, spot, count(*) AS times FROM (SELECT n, r, CAST('0x' || substr(md5('42|' || r || '|' || p), 1, 8) AS BIGINT) % n AS spot FROM (SELECT DISTINCT n FROM bv), range(10000) t(r), range(1000000) u(p) WHERE p < n) GROUP BY ALL),
bs AS (SELECT system, metric, r, CAST(sum(times * v) AS BIGINT) AS s FROM bd JOIN bv USING (n, spot) GROUP BY ALL),
bo AS (SELECT system, metric, s, row_number() OVER (PARTITION BY system, metric ORDER BY s) AS k FROM bs),
be AS (SELECT system, metric, max(s) FILTER (k = 250) * 25 + max(s) FILTER (k = 251) * 975 AS lower, max(s) FILTER (k = 9750) * 975 + max(s) FILTER (k = 9751) * 25 AS upper FROM bo GROUP BY ALL),
bb AS (SELECT system, metric, CAST(sum(v) AS BIGINT) / (count(*) * 1000000) AS mean, coalesce(stddev_samp(value), 0) AS std, count(*) AS n FROM bv GROUP BY ALL)"""


@query("x05_bootstrap", f"WITH {LONG}, {_BOOT} SELECT system, metric, mean, CASE WHEN n < 2 THEN mean ELSE lower / (n * 1000000000) END AS lower, CASE WHEN n < 2 THEN mean ELSE upper / (n * 1000000000) END AS upper, round(std, 6) AS std FROM bb JOIN be USING (system, metric)")
def _(s, d):
    return st.bootstrap(long(s, d))


@query("x06_direction", f"WITH {_CMP} SELECT a, b, metric, CAST(sign(avg(x - y)) AS INT) AS direction FROM pr GROUP BY ALL")
def _(s, d):
    return st.t_tests(st.compared(long(s, d, whole_run), "bm25")).select("a", "b", "metric", "direction")


@query("x07_best_systems", f"WITH {LONG}, mm AS (SELECT system, metric, round(avg(value), 6) AS mean FROM lm GROUP BY ALL) SELECT metric, arg_max(system, (mean, -list_position({SYSTEMS}, system))) AS system, max(mean) AS mean FROM mm GROUP BY metric")
def _(s, d):
    return st.best_systems(me.graded_only(long(s, d), qrels(s, d)), SYSTEMS)


@query("x08_analysis")
def _(s, d):
    """Long: the tests of each pair, each system's number of queries, mean and interval, and each metric's best system."""
    values = long(s, d).filter(F.col("metric").isin("ap", "rr", "ndcg_10"))
    pairs_ = st.compared(values, "bm25")
    own = lambda df, test, value: df.select("a", "b", "metric", F.lit(test).alias("test"), F.col(value).cast("double").alias("statistic"), "p_value", "mark")
    alone = lambda df, test, value: own(df.select(F.col("system").alias("a"), F.lit(None).cast("string").alias("b"), "metric", value, F.lit(None).cast("double").alias("p_value"), F.lit("").alias("mark")), test, value)
    out = own(st.marked(st.t_tests(pairs_)), "paired t", "t").unionByName(own(st.marked(st.wilcoxon_tests(pairs_)), "wilcoxon", "w"))
    means, intervals = me.graded_only(values, qrels(s, d)), st.bootstrap(values)
    for part in (alone(means, "queries", "n"), alone(means, "mean", "mean"), alone(intervals, "interval from", "lower"), alone(intervals, "interval to", "upper"), alone(st.best_systems(means, SYSTEMS), "best", "mean")):
        out = out.unionByName(part)
    return out


def _variants(s, d):
    """The metrics of even and odd queries as two variants of a configuration, beside all of them."""
    m = long(s, d).withColumn("variant", F.lit("base"))
    return m.unionByName(m.withColumns({"variant": F.lit("twice"), "value": F.col("value") * 0.5 + 0.25})).unionByName(m.withColumns({"variant": F.lit("less"), "value": F.col("value") * 0.9}))


_VAR = f"{LONG}, va AS MATERIALIZED (SELECT 'base' AS variant, * FROM lm UNION ALL SELECT 'twice', system, query_id, metric, value * 0.5 + 0.25 FROM lm UNION ALL SELECT 'less', system, query_id, metric, value * 0.9 FROM lm), vm AS MATERIALIZED (SELECT variant, system, metric, round(avg(value), 6) AS mean FROM va GROUP BY ALL), de AS MATERIALIZED (SELECT v.variant, system, metric, b.mean AS baseline, v.mean AS value, round(v.mean - b.mean, 6) AS delta, round(CASE WHEN b.mean > 0 THEN (v.mean - b.mean) / b.mean * 100 ELSE 0.0 END, 2) AS delta_pct FROM vm v JOIN (SELECT system, metric, mean FROM vm WHERE variant = 'base') b USING (system, metric) WHERE v.variant <> 'base')"


def _deltas(s, d):
    means = _variants(s, d).groupBy("variant", "system", "metric").agg(me.mean("value").alias("mean"))
    return st.deltas(means, "base")


@query("x09_variant_tests", f"WITH {_VAR}, pr AS (SELECT system, a.variant AS a, 'base' AS b, metric, a.value AS x, b.value AS y FROM va a JOIN lm b USING (system, metric, query_id) WHERE a.variant <> 'base'), g AS (SELECT system, a, b, metric, count(*) AS n, avg(x - y) AS m, stddev_samp(x - y) AS sd FROM pr GROUP BY ALL) SELECT system, a, b, metric, n, round(CASE WHEN sd > 1e-12 THEN m / (sd / sqrt(n)) END, 4) AS t FROM g")
def _(s, d):
    v = _variants(s, d).select(F.col("system").alias("own"), F.col("variant").alias("system"), "metric", "query_id", "value")
    t = st.t_tests(st.compared(v, "base", ("own",)), ("own",))
    return t.select(F.col("own").alias("system"), "a", "b", "metric", "n", F.round("t", 4).alias("t"))


@query("x10_delta_table", f"WITH {_VAR} SELECT * FROM de")
def _(s, d):
    return _deltas(s, d)


@query("x11_ranked_variants", f"WITH {_VAR}, av AS (SELECT variant, metric, round(avg(delta_pct), 2) AS p FROM de GROUP BY ALL), r AS (SELECT variant, round(avg(p), 2) AS delta_pct FROM av GROUP BY variant) SELECT variant, delta_pct, CAST(row_number() OVER (ORDER BY delta_pct DESC, variant) AS INT) AS rank FROM r")
def _(s, d):
    return st.ranked_variants(st.average_deltas(_deltas(s, d)))


_TP = f"{QRELS}, tp AS (SELECT 'query: ' || b.text AS anchor, 'passage: ' || d.text AS passage, lang FROM qrels JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id))"


@query("g01_query_pairs", f"WITH {_TP} SELECT * FROM tp")
def _(s, d):
    return tr.query_pairs(qrels(s, d), _q(s, d), table(s, d, "documents"))


_form = "trim(regexp_replace(coalesce({}, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"  # for texts without Arabic marks
_CP = f"""{PAIRS}, cp AS (SELECT 'query: ' || CASE l WHEN 'ar' THEN {_form.format('c')} ELSE c END AS anchor, 'passage: ' || CASE l WHEN 'ar' THEN {_form.format('text')} ELSE text END AS passage, l AS lang
  FROM (SELECT doc_id, concept_en AS c, 'en' AS l FROM pairs WHERE status = 'verified' UNION ALL SELECT doc_id, concept_ar, 'ar' FROM pairs WHERE status = 'verified') JOIN documents USING (doc_id) WHERE c IS NOT NULL AND c <> '')"""


@query("g02_concept_pairs", f"WITH {_CP} SELECT * FROM cp")
def _(s, d):
    return tr.concept_pairs(pairs(s, d), table(s, d, "documents"))


@query("g03_training_set", f"WITH {_TP}, {_CP} SELECT lang, count(*) AS n FROM (SELECT * FROM tp UNION ALL SELECT * FROM cp) GROUP BY lang")
def _(s, d):
    docs = table(s, d, "documents")
    both = tr.query_pairs(qrels(s, d), _q(s, d), docs).unionByName(tr.concept_pairs(pairs(s, d), docs))
    return both.groupBy("lang").agg(F.count("*").alias("n"))


@query("g04_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('split' || doc_id)) <= greatest(1, CAST(floor(count(*) OVER () * 0.15) AS BIGINT)) THEN 'validation' ELSE 'train' END AS part FROM documents")
def _(s, d):
    return tr.split(table(s, d, "documents").select("doc_id"), "doc_id")


@query("g05_leakage", "SELECT doc_id FROM documents WHERE trim(regexp_replace(lower(coalesce(split_part(text, chr(10), 1), '')), '[ \\t\\n\\r\\f]+', ' ', 'g')) IN (SELECT trim(regexp_replace(lower(coalesce(split_part(text, chr(10), 1), '')), '[ \\t\\n\\r\\f]+', ' ', 'g')) FROM documents WHERE doc_id % 10 = 0)")
def _(s, d):
    rows = table(s, d, "documents").select("doc_id", F.coalesce(F.substring_index("text", "\n", 1), F.lit("")).alias("text"))
    return tr.leaks(rows, rows.filter("doc_id % 10 = 0")).select("doc_id")


@query("l01_parsed_log", f"WITH {LOG} SELECT path, status, count(*) AS n, CAST(0 AS BIGINT) AS bad FROM log GROUP BY path, status UNION ALL SELECT '', 0, count(*), count(*) FROM events WHERE event_id % 100 = 0")
def _(s, d):
    log = request_log(s, d)
    lines = log.select(F.to_json(F.struct(*log.columns)).alias("value")).unionByName(table(s, d, "events").filter("event_id % 100 = 0").select(F.lit("{broken").alias("value")))
    good, bad = lo.parsed(lines)
    return good.groupBy("path", "status").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("bad")).unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("").alias("path"), F.lit(0).alias("status"), "n", F.col("n").alias("bad")))


@query("l02_request_counts", f"WITH {LOG} SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, path, status, count(*) AS n FROM log GROUP BY ALL")
def _(s, d):
    return lo.request_counts(request_log(s, d)).withColumn("start", F.unix_timestamp("start"))


@query("l03_histogram", f"WITH {LOG}, e AS (SELECT unnest([{', '.join(map(str, lo.EDGES))}, 'infinity'::DOUBLE]) AS edge) SELECT path, edge, count(*) FILTER (duration_ms / 1000 <= edge) AS n FROM log, e GROUP BY ALL")
def _(s, d):
    return lo.histogram(request_log(s, d))


_SLIDE = "w AS (SELECT log.*, epoch(date_trunc('minute', ts))::BIGINT - 60 * i AS start FROM log, range(5) t(i))"


def _quantile_sql() -> str:
    out = "30.0"
    for i in range(len(lo.EDGES) - 1, -1, -1):
        low, under = ("0.0", "0") if i == 0 else (str(lo.EDGES[i - 1]), f"le[{i}]")
        out = f"CASE WHEN le[{i + 1}] >= 0.95 * n THEN {low} + ({lo.EDGES[i]} - {low}) * coalesce((0.95 * n - {under}) / nullif(le[{i + 1}] - {under}, 0), 0.0) ELSE {out} END"
    return out


@query("l04_latency_alerts", f"WITH {LOG}, {_SLIDE}, h AS (SELECT start, count(*) AS n, [{', '.join(f'count(*) FILTER (duration_ms / 1000 <= {e})' for e in lo.EDGES)}] AS le FROM w GROUP BY start), q AS (SELECT start, n, round({_quantile_sql()}, 6)::DOUBLE AS quantile FROM h) SELECT *, quantile > 2.0 AS alert FROM q")
def _(s, d):
    return lo.latency_alerts(request_log(s, d)).drop("at").withColumn("start", F.unix_timestamp("start"))


@query("l05_rate_alerts", f"WITH {LOG}, {_SLIDE}, h AS (SELECT start, count(*) AS n, count(*) FILTER (status >= 500 AND status <> 503) AS failed, count(*) FILTER (status = 503) AS busy FROM w GROUP BY start) SELECT *, failed / n > 0.02 AND n / 300 > 0.1 AS error_alert, busy / n > 0.05 AS busy_alert FROM h")
def _(s, d):
    return lo.rate_alerts(request_log(s, d)).drop("at").withColumn("start", F.unix_timestamp("start"))


@query("l06_lasting_alerts", f"WITH {LOG}, {_SLIDE}, h AS (SELECT start FROM w GROUP BY start HAVING count(*) FILTER (status = 503) / count(*) > 0.05), g AS (SELECT start, start - 60 * row_number() OVER (ORDER BY start) AS g FROM h) SELECT min(start) AS \"from\", max(start) AS until, count(*) AS n FROM g GROUP BY g HAVING max(start) - min(start) + 60 >= 600")
def _(s, d):
    out = lo.lasting(lo.rate_alerts(request_log(s, d)), "busy_alert")
    return out.select(F.unix_timestamp("from").alias("from"), F.unix_timestamp("until").alias("until"), "n")


_LASTING = """h AS (SELECT path, start FROM w GROUP BY path, start HAVING count(*) FILTER (status = 503) / count(*) > 0.05), g AS (SELECT path, start, start - 60 * row_number() OVER (PARTITION BY path ORDER BY start) AS g FROM h),
la AS (SELECT path, min(start) AS "from", max(start) AS until, count(*) AS n FROM g GROUP BY path, g HAVING max(start) - min(start) + 60 >= 600)"""


@query("l06_stream_lasting_alerts", f"WITH {LOG}, {_SLIDE}, {_LASTING} SELECT * FROM la WHERE until + 360 <= (SELECT epoch(max(ts)) - 600 FROM log)")
def _(s, d):
    """Stretches of busy windows of each route from a stream whose rows come up to seven minutes late."""
    log = request_log(s, d)
    files = _as_files(s, log, at=F.unix_timestamp("ts") + F.col("request_id").cast("long") % 7 * 60)
    out = live.finish(live.lasting(live.read(s, files, log.schema)), store.workspace(s), store.workspace(s), conf=live.STATE_STORE)
    return out.select("path", F.unix_timestamp("from").alias("from"), F.unix_timestamp("until").alias("until"), "n")


@query("l06_lasting_by_route", f"WITH {LOG}, {_SLIDE}, {_LASTING} SELECT * FROM la")
def _(s, d):
    out = lo.lasting(lo.rate_alerts(request_log(s, d), by=("path",)), "busy_alert", by=("path",))
    return out.select("path", F.unix_timestamp("from").alias("from"), F.unix_timestamp("until").alias("until"), "n")


@query("l07_method_summary", f"""WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY duration_ms) AS r, count(*) OVER (PARTITION BY path) AS n FROM log)
SELECT path, count(*) AS n, count(*) FILTER (status >= 500) AS failures, round(count(*) / greatest(floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT, 1), 6) AS rps, {', '.join(f'min(duration_ms) FILTER (r >= ceil({q} * n)) AS p{int(q * 100)}' for q in (0.5, 0.95, 0.99))} FROM r GROUP BY path""")
def _(s, d):
    return lo.method_summary(request_log(s, d))


def _as_files(s, df, parts: int = 4, at=None) -> str:
    """Rows written in the order of arrival (of time, if not given), one append after another: a stream reads files by their age."""
    root = store.workspace(s)
    at = F.unix_timestamp(F.col("ts" if "ts" in df.columns else "event_time").cast("timestamp")) if at is None else at
    edges = df.select(at.alias("at")).approxQuantile("at", [i / parts for i in range(1, parts)], 0.01)
    for low, high in zip([None, *edges], [*edges, None]):
        part = df.filter(at > low) if low is not None else df
        (part.filter(at <= high) if high is not None else part).write.mode("append").parquet(root)
    return root


@query("l02_stream_request_counts", f"WITH {LOG}, c AS (SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, path, status, count(*) AS n FROM log GROUP BY ALL) SELECT * FROM c WHERE start + 3600 <= (SELECT epoch(max(ts)) - 3600 FROM log)")
def _(s, d):
    log = request_log(s, d)
    stream = live.counts(live.read(s, _as_files(s, log), log.schema))
    return live.finish(stream, store.workspace(s), store.workspace(s)).withColumn("start", F.unix_timestamp("start"))


@query("l08_stream_labels", f"WITH {LABELS} SELECT annotator_id, query_id, doc_id, label FROM lab")
def _(s, d):
    e = label_events(s, d)
    stream = live.read(s, _as_files(s, e), e.schema)
    return live.upsert(stream, ["annotator_id", "query_id", "doc_id"], "label", store.workspace(s), store.workspace(s)).drop("updated_at")



