"""Queries of sources, cleaning, reconstruction, audits and the profile (S, P, N, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stopwords import ARABIC
from ..operators import corpus as co
from ..operators import profiling as pf
from ..sources import files, store
from .base import CORPUS, WORDS, clean, corpus, query, table

_FULL, _ISNAD, _MATN = clean("en_full"), clean("en_isnad"), clean("en_matn")


@query("s03_guarded_union", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    parts = [docs.filter(F.col("doc_id") % 2 == i) for i in range(2)]
    return store.guarded_union(parts, 200).groupBy("source").agg(F.count("*").alias("n"))


_FLAT = f"""WITH {CORPUS} SELECT id, c.book, chapter_number, CASE WHEN chapter_number <= 10 THEN title END AS title, 'Book ' || c.book AS book_name, array_to_string({WORDS.format('en_full')}, ' ') AS prepared"""


def _flat(s, d):
    rows = corpus(s, d)
    chapters = rows.filter("chapter_number <= 10").select("book", "chapter_number", "title").distinct()
    books = rows.select("book").distinct().withColumn("book_name", F.concat(F.lit("Book "), F.col("book")))
    ready = co.prepared(rows, {"prepared": tx.english_words(F.col("en_full"))})
    return co.flat(rows.drop("title"), chapters, books, ready)


@query("s04_flat_view", f"{_FLAT} FROM corpus c")
def _(s, d):
    return _flat(s, d).select("id", "book", "chapter_number", "title", "book_name", "prepared")


@query("s12_aliased_view", f"WITH {CORPUS} SELECT id, id AS hadith_no, book AS source_book, CASE WHEN chapter_number <= 10 THEN title END AS chapter FROM corpus")
def _(s, d):
    return co.aliased(_flat(s, d), {"hadith_no": "id", "source_book": "book", "chapter": "title"}).select("id", "hadith_no", "source_book", "chapter")


@query("s05_dimensions", f"WITH {CORPUS} SELECT book, count(DISTINCT chapter_number) AS chapters, count(*) AS documents FROM corpus GROUP BY book")
def _(s, d):
    books, chapters, docs = co.dimensions(corpus(s, d))
    c = chapters.groupBy("book").agg(F.count("*").alias("chapters"))
    return books.join(c, "book").join(docs.groupBy("book").agg(F.count("*").alias("documents")), "book").select("book", "chapters", "documents")


@query("s06_atomic_replace", "SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0")
def _(s, d):
    root = store.workspace(s)
    docs = table(s, d, "documents").select("doc_id", "source")
    store.replace(docs, root)
    store.replace(docs.filter("doc_id % 2 = 0"), root, least=1)
    return store.live(s, root)


@query("s07_orphans", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source <> 'src1')")
def _(s, d):
    return store.orphans(table(s, d, "labels").select("doc_id", "quality"), table(s, d, "documents").filter("source <> 'src1'"), "doc_id")


@query("s09_archived_results", "SELECT source, count(*) AS n, 'r' || i AS run_ts FROM documents, range(2) t(i) GROUP BY source, i")
def _(s, d):
    root = store.workspace(s)
    found = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    for i in range(2):
        store.archive(found, root, f"r{i}")
    return s.read.schema("source string, n long, run_ts string").json(root)


@query("s10_vector_upsert", "SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 0 THEN -label ELSE label END AS INT) AS label FROM embeddings UNION ALL SELECT vec_id + 10000000, CAST(0 AS INT) FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 2 = 0")
def _(s, d):
    old = table(s, d, "embeddings").select("vec_id", "label")
    new = old.filter("vec_id % 3 = 0").select("vec_id", (-F.col("label")).alias("label"))
    new = new.unionByName(new.filter("vec_id % 2 = 0").select((F.col("vec_id") + 10_000_000).alias("vec_id"), F.lit(0).alias("label")))
    return store.upsert(old, new, "vec_id")


@query("s01_csv_scan", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, nullif({clean("split_part(text, chr(10), 1)")}, '') AS title, 'source=' || source AS book FROM documents")
def _(s, d):
    """Documents written as CSV files, a folder for each source, and scanned as books."""
    root = store.workspace(s)
    table(s, d, "documents").select("doc_id", "lang", tx.clean(F.substring_index("text", "\n", 1)).alias("title"), "source").write.partitionBy("source").option("header", True).csv(root)
    return files.corpus_csv(s, root, ["doc_id", "lang", "title"]).drop("file")


_JUDGED = "greatest(0, least(2, CAST(doc_id % 4 AS INT) - 1))"


@query("s08_json_sources", f"""SELECT 'query' AS kind, CAST(item_id AS VARCHAR) AS query_id, CAST(NULL AS BIGINT) AS doc_id, text, CAST(NULL AS INT) AS grade FROM benchmark
UNION ALL SELECT 'judgment', CAST(doc_id % 9 AS VARCHAR), doc_id, NULL, {_JUDGED} FROM documents""")
def _(s, d):
    """Queries and judgments written as the JSON objects of one evaluation, a map each, and read back."""
    asked = table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    judged = table(s, d, "documents").selectExpr("cast(doc_id % 9 AS string) AS query_id", "cast(doc_id AS string) AS doc_id", f"{_JUDGED} AS grade")
    grades = judged.groupBy("query_id").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("doc_id", "grade"))).alias("grades")).alias("judged"))
    paths = {}
    for name, rows, value in (("queries", asked, "text"), ("qrels", grades, "judged")):
        paths[name] = store.workspace(s)
        rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("query_id", value)))).alias("value")).write.text(paths[name])
    none = lambda kind: F.lit(None).cast(kind)
    q = files.queries_json(s, paths["queries"]).select(F.lit("query").alias("kind"), "query_id", none("long").alias("doc_id"), "text", none("int").alias("grade"))
    return q.unionByName(files.qrels_json(s, paths["qrels"]).select(F.lit("judgment").alias("kind"), "query_id", "doc_id", none("string").alias("text"), "grade"))


@query("s11_old_columns", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'old ' || source ELSE source END AS book, lang AS language FROM documents")
def _(s, d):
    """Old names give way to new ones where the new value is null, and are renamed where there is no new column."""
    old = table(s, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 <> 0 THEN source END AS book", "concat('old ', source) AS book_name", "lang")
    return files.renamed(old, {"book_name": "book", "lang": "language", "gone": "book"}).select("doc_id", "book", "language")


@query("p01_clean_text", f"SELECT doc_id, {clean('text')} AS cleaned, {clean('text')} <> '' AS has_text, CASE WHEN {clean('text')} <> '' THEN 'original' ELSE 'missing' END AS provenance FROM documents")
def _(s, d):
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", tx.clean(t).alias("cleaned"), tx.has_text(t).alias("has_text"), tx.provenance(t).alias("provenance"))


@query("p04_remove_affixes", f"""WITH {CORPUS}, c AS (SELECT id, {_FULL} AS f, {_ISNAD} AS i, {_MATN} AS m FROM corpus)
SELECT id, CASE WHEN f <> '' AND i <> '' AND starts_with(f, i) THEN trim(substr(f, len(i) + 1)) ELSE '' END AS rest, CASE WHEN f <> '' AND m <> '' AND ends_with(f, m) THEN trim(substr(f, 1, len(f) - len(m))) ELSE '' END AS head FROM c""")
def _(s, d):
    f, i, m = F.col("en_full"), F.col("en_isnad"), F.col("en_matn")
    return corpus(s, d).select("id", tx.without_prefix(f, i).alias("rest"), tx.without_suffix(f, m).alias("head"))


RECONSTRUCTED = f"""{CORPUS},
c0 AS (SELECT id, book, grade_a, grade_b, {_FULL} AS f, {_ISNAD} AS i, {_MATN} AS m FROM corpus),
c1 AS (SELECT *, trim(concat_ws(' ', nullif(i, ''), nullif(m, ''))) AS nf FROM c0),
c2 AS (SELECT * EXCLUDE (f, nf), CASE WHEN f = '' AND nf <> '' THEN nf ELSE f END AS f, CASE WHEN f <> '' THEN 'original' WHEN nf <> '' THEN 'reconstructed_from_isnad_matn' ELSE 'missing' END AS fs FROM c1),
c3 AS (SELECT *, CASE WHEN f <> '' AND i <> '' AND starts_with(f, i) THEN trim(substr(f, len(i) + 1)) ELSE '' END AS nm FROM c2),
c4 AS (SELECT * EXCLUDE (m, nm), CASE WHEN m = '' AND nm <> '' THEN nm ELSE m END AS m, CASE WHEN m <> '' THEN 'original' WHEN nm <> '' THEN 'reconstructed_from_full_minus_isnad' ELSE 'missing' END AS ms FROM c3),
c5 AS (SELECT *, CASE WHEN f <> '' AND m <> '' AND ends_with(f, m) THEN trim(substr(f, 1, len(f) - len(m))) ELSE '' END AS ni FROM c4),
c6 AS MATERIALIZED (SELECT * EXCLUDE (i, ni), CASE WHEN i = '' AND ni <> '' THEN ni ELSE i END AS i, CASE WHEN i <> '' THEN 'original' WHEN ni <> '' THEN 'reconstructed_from_full_minus_matn' ELSE 'missing' END AS isrc FROM c5)"""


@query("p05_reconstruct", f"WITH {RECONSTRUCTED} SELECT id, f AS en_full, i AS en_isnad, m AS en_matn, fs AS en_full_source, isrc AS en_isnad_source, ms AS en_matn_source FROM c6")
def _(s, d):
    return co.reconstructed(corpus(s, d)).select("id", *[f"en_{p}" for p in co.PARTS], *[f"en_{p}_source" for p in co.PARTS])


@query("p06_reconstruction_counts", f"WITH {RECONSTRUCTED} SELECT 'en' AS lang, part, count(*) FILTER (starts_with(src, 'reconstructed')) AS n FROM (SELECT 'full' AS part, fs AS src FROM c6 UNION ALL SELECT 'isnad', isrc FROM c6 UNION ALL SELECT 'matn', ms FROM c6) GROUP BY part")
def _(s, d):
    return co.reconstruction_counts(co.reconstructed(corpus(s, d)))


_NAMED = (
    ("Sahih", r"\b(sahih|saheeh|authentic)\b", "صحيح"), ("Hasan", r"\b(hasan|good)\b", "حسن"),
    ("Da''if", r"\b(da[^a-z0-9]*if|daeef|weak)\b", "ضعيف"), ("Mawdu", r"\b(ma(w)?du([^a-z0-9]*)|fabricated|forged)\b", "موضوع"),
)


def _flags(x: str) -> str:
    parts = ", ".join(f"CASE WHEN regexp_matches(l, '{e}') OR contains(l, '{a}') THEN '{n}' END" for n, e, a in _NAMED)
    return f"(SELECT list_filter([{parts}], lambda x: x IS NOT NULL) FROM (SELECT lower({clean(x)}) AS l))"


_G = f"{CORPUS}, g AS (SELECT id, book, grade_a, grade_b, {_flags('grade_a')} AS fa, {_flags('grade_b')} AS fb FROM corpus), gn AS (SELECT *, list_distinct(list_concat(fa, fb)) AS u FROM g), grades AS MATERIALIZED (SELECT *, CASE WHEN len(u) = 1 THEN u[1] WHEN len(u) = 2 AND list_contains(u, 'Sahih') AND list_contains(u, 'Hasan') THEN 'Hasan' ELSE 'Unknown' END AS grade FROM gn)"


@query("p07_grade_flags", f"WITH {_G} SELECT id, array_to_string(fa, ',') AS a, array_to_string(fb, ',') AS b FROM grades")
def _(s, d):
    return corpus(s, d).select("id", F.array_join(tx.grade_flags(F.col("grade_a")), ",").alias("a"), F.array_join(tx.grade_flags(F.col("grade_b")), ",").alias("b"))


@query("p08_normal_grade", f"WITH {_G} SELECT id, grade FROM grades")
def _(s, d):
    return corpus(s, d).select("id", tx.normal_grade(F.col("grade_a"), F.col("grade_b")).alias("grade"))


@query("p09_content_flags", f"WITH {CORPUS} SELECT id, {_FULL} <> '' OR {_ISNAD} <> '' OR {_MATN} <> '' AS has_en_content, {_MATN} <> '' AS has_en_matn FROM corpus")
def _(s, d):
    return co.content_flags(corpus(s, d)).select("id", "has_en_content", "has_en_matn")


@query("p10_renumber", f"WITH {CORPUS} SELECT id, row_number() OVER (ORDER BY book, id) AS number FROM corpus")
def _(s, d):
    return co.renumbered(corpus(s, d).select("book", "id"), ["book", "id"], "number").select("id", "number")


@query("p11_first_drop", f"WITH {CORPUS} SELECT id, CASE WHEN {_MATN} <> '' THEN 'kept' ELSE 'dropped' END AS part FROM corpus")
def _(s, d):
    kept, gone = co.split_by(corpus(s, d).select("id", "en_matn"), tx.has_text(F.col("en_matn")))
    return kept.select("id", F.lit("kept").alias("part")).unionByName(gone.select("id", F.lit("dropped").alias("part")))


@query("p12_second_drop_audit", f"WITH {CORPUS}, p AS (SELECT len({WORDS.format('en_matn')}) = 0 AS m, len({WORDS.format('en_isnad')}) = 0 AS i FROM corpus) SELECT 'matn' AS what, count(*) FILTER (m) AS n FROM p UNION ALL SELECT 'isnad', count(*) FILTER (i) FROM p UNION ALL SELECT 'any', count(*) FILTER (m OR i) FROM p")
def _(s, d):
    ready = co.prepared(corpus(s, d), {"matn": tx.english_words(F.col("en_matn")), "isnad": tx.english_words(F.col("en_isnad"))})
    return co.empty_audit(ready, ["matn", "isnad"])


@query("p13_number_label", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 3 = 1 THEN doc_id || ' -' || (doc_id + 1) ELSE '' END AS label FROM documents")
def _(s, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.col("doc_id"), F.lit(".0"))).when(F.col("doc_id") % 3 == 1, F.concat(F.col("doc_id"), F.lit(" -"), F.col("doc_id") + 1)).otherwise("nan")
    return table(s, d, "documents").select("doc_id", tx.number_label(raw).alias("label"))


@query("p14_row_filter", f"WITH {_G} SELECT id FROM grades WHERE grade = 'Hasan' AND book IN ('src1', 'src2')")
def _(s, d):
    rows = corpus(s, d)
    allowed = rows.filter((tx.normal_grade(F.col("grade_a"), F.col("grade_b")) == "Hasan") & F.col("book").isin("src1", "src2")).select("id")
    return rows.select("id").join(allowed, "id", "left_semi")


@query("p15_result_defaults", f"WITH {CORPUS} SELECT id, coalesce(grade_a, 'Unknown') AS grade, coalesce(grade_b, '') AS note FROM corpus")
def _(s, d):
    return corpus(s, d).select("id", F.coalesce("grade_a", F.lit("Unknown")).alias("grade"), F.coalesce("grade_b", F.lit("")).alias("note"))


@query("n08_fold", "SELECT doc_id, trim(regexp_replace(lower(trim(split_part(text, chr(10), 1))), '[^\\p{L}]+', ' ', 'g')) AS folded FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", tx.fold(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)).alias("folded"))


@query("n09_prepared_columns", f"WITH {CORPUS} SELECT id, " + ", ".join(f"array_to_string({WORDS.format('en_' + p)}, ' ') AS {p}" for p in co.PARTS) + " FROM corpus")
def _(s, d):
    return co.prepared(corpus(s, d), {p: tx.english_words(F.col(f"en_{p}")) for p in co.PARTS})


@query("n10_anchors", "SELECT doc_id, 'passage: ' || coalesce(text, '') AS passage, 'query: ' || coalesce(split_part(text, chr(10), 1), '') AS question FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", tx.anchor(F.col("text"), "passage", F.col("lang")).alias("passage"), tx.anchor(F.substring_index("text", "\n", 1), "query", F.col("lang")).alias("question"))


#: Latin letters of the given texts and the Arabic letters and marks that stand for them: texts with every form that the rules treat.
_LATIN, _ARABIC = "abcdefghijklmnopqrstuvwxyzEHITO", "أبجدَهوزحطٱكلمنسعفصقرشتثخذىةـؤئ"


def arabic(c):
    return F.translate(F.coalesce(c, F.lit("")), _LATIN, _ARABIC)


_AR = f"translate(coalesce(text, ''), '{_LATIN}', '{_ARABIC}')"
_UNMARK = "regexp_replace({}, '[\u064B-\u0652\u0670]', '', 'g')"
_RULES = "translate({}, 'إأٱآىؤئ', 'ااااي' || 'ءء')"
_SPACED = "trim(regexp_replace({}, '[ \t\n\r\f]+', ' ', 'g'))"


@query("n04_arabic_forms", f"""SELECT doc_id, {_SPACED.format("replace(translate(regexp_replace(t, '[^" + chr(0x600) + "-" + chr(0x6FF) + " \t\n\r\f]', ' ', 'g'), 'إأٱآىةؤئ', 'ااااي' || 'ه' || 'ءء'), 'ـ', '')")} AS normal,
{_SPACED.format(_UNMARK.format('t'))} AS encoder, left({_SPACED.format("replace(regexp_replace(regexp_replace(t, '[ً-ٟ]', '', 'g'), '[ـٰ]', '', 'g'), 'ٱ', 'ا')")}, 1200) AS reranker FROM (SELECT doc_id, {_AR} AS t FROM documents)""")
def _(s, d):
    t = arabic(F.col("text"))
    return table(s, d, "documents").select("doc_id", tx.arabic_normal(t).alias("normal"), tx.encoder_form(t).alias("encoder"), tx.reranker_form(t).alias("reranker"))


_AN = f"""tk AS MATERIALIZED (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT doc_id, string_split({_SPACED.format(_AR)}, ' ') AS w FROM documents) ),
an AS MATERIALIZED (SELECT token, token[1:len(token) - 1] AS lemma, CASE len(token) % 5 WHEN 0 THEN 'prep' WHEN 1 THEN 'noun' WHEN 2 THEN 'punc' ELSE 'verb' END AS pos FROM (SELECT DISTINCT token FROM tk WHERE len(token) % 3 <> 0)),
st AS (SELECT list({_RULES.format(_UNMARK.format('w'))}) AS stop FROM (SELECT unnest({list(ARABIC)}) AS w)),
kept AS (SELECT doc_id, tk.pos, CASE WHEN an.token IS NOT NULL THEN {_RULES.format(_UNMARK.format('lemma'))} ELSE {_UNMARK.format('tk.token')} END AS w, an.token IS NOT NULL AS known, an.pos AS kind FROM tk LEFT JOIN an USING (token))"""


@query("n05_arabic_tokens", f"""WITH {_AN} SELECT d.doc_id, coalesce(joined, '') AS joined FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(CASE WHEN known THEN w ELSE {_RULES.format('w')} END, ' ' ORDER BY pos) AS joined FROM kept, st WHERE len(w) >= 2 AND NOT list_contains(stop, w) AND (NOT known OR kind NOT IN ('prep', 'conj', 'part', 'punc')) GROUP BY doc_id) k USING (doc_id)""")
def _(s, d):
    """Texts put into Arabic letters; two tokens in three have an analysis: all but their last letter, a part of speech by length."""
    own = table(s, d, "documents").select("doc_id", F.lit("ar").alias("lang"), F.split(F.trim(F.regexp_replace(arabic(F.col("text")), tx.SPACE, " ")), " ").alias("tokens"))
    n = F.length("token")
    analyses = own.select(F.explode("tokens").alias("token")).distinct().filter(n % 3 != 0).select("token", F.substring("token", F.lit(1), n - 1).alias("lemma"), F.when(n % 5 == 0, "prep").when(n % 5 == 1, "noun").when(n % 5 == 2, "punc").otherwise("verb").alias("pos"))
    return co.analysed(own, analyses).select("doc_id", F.array_join("tokens", " ").alias("joined"))


@query("f01_rows_by_book", f"WITH {CORPUS} SELECT book AS value, count(*) AS n FROM corpus GROUP BY book")
def _(s, d):
    return pf.counts(corpus(s, d), "book")


@query("f02_grade_distribution", f"WITH {_G} SELECT coalesce(grade_a, '(missing)') AS value, count(*) AS n, 'raw' AS kind FROM grades GROUP BY ALL UNION ALL SELECT grade, count(*), 'normal' FROM grades GROUP BY grade")
def _(s, d):
    rows = corpus(s, d).withColumn("grade", tx.normal_grade(F.col("grade_a"), F.col("grade_b")))
    return pf.counts(rows, "grade_a", 40).withColumn("kind", F.lit("raw")).unionByName(pf.counts(rows, "grade", 40).withColumn("kind", F.lit("normal")))


@query("f03_grade_diagnostics", f"""WITH {_G}, k AS (SELECT {clean('grade_a')} = '' AS a, {clean('grade_b')} = '' AS b, grade <> 'Unknown' AS known FROM grades)
SELECT 'a missing' AS what, count(*) FILTER (a) AS n FROM k UNION ALL SELECT 'b missing', count(*) FILTER (b) FROM k UNION ALL SELECT 'both missing', count(*) FILTER (a AND b) FROM k
UNION ALL SELECT 'a missing, recovered', count(*) FILTER (a AND NOT b AND known) FROM k UNION ALL SELECT 'b missing, recovered', count(*) FILTER (NOT a AND b AND known) FROM k UNION ALL SELECT 'unknown', count(*) FILTER (NOT known) FROM k""")
def _(s, d):
    return pf.grade_diagnostics(corpus(s, d), "grade_a", "grade_b")


@query("f03_unknown_reasons", f"""WITH {_G}, k AS (SELECT {clean('grade_a')} AS a, {clean('grade_b')} AS b, len(u) AS many FROM grades WHERE grade = 'Unknown')
SELECT CASE WHEN a = '' AND b = '' THEN 'missing both' WHEN many > 1 THEN 'conflict' WHEN a = '' THEN 'a missing, b not recognised' WHEN b = '' THEN 'b missing, a not recognised' ELSE 'not recognised' END AS reason, a, b, count(*) AS n FROM k GROUP BY ALL""")
def _(s, d):
    return pf.unknown_reasons(corpus(s, d), "grade_a", "grade_b")


_COLS = ("en_full", "en_isnad", "en_matn", "grade_a", "grade_b")


@query("f04_coverage", f"WITH {CORPUS}, l AS (" + " UNION ALL ".join(f"SELECT book, '{c}' AS col, {clean(c)} <> '' AS f FROM corpus" for c in _COLS) + ") SELECT coalesce(book, '(all)') AS book, col AS \"column\", count(*) FILTER (f) AS filled, count(*) AS n FROM l GROUP BY GROUPING SETS ((col, book), (col))")
def _(s, d):
    return pf.coverage(corpus(s, d), list(_COLS), "book")


@query("f05_length_statistics", """WITH l AS (SELECT lang AS "group", CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS INT) AS len FROM documents)
SELECT "group", min(len) AS min, round(quantile_cont(len, 0.25), 4) AS p25, round(quantile_cont(len, 0.5), 4) AS p50, round(quantile_cont(len, 0.75), 4) AS p75, round(quantile_cont(len, 0.9), 4) AS p90, max(len) AS max, round(avg(len), 4) AS mean FROM l GROUP BY ALL""")
def _(s, d):
    return pf.length_stats(table(s, d, "documents"), "text", "lang")


@query("f06_duplicates", f"""WITH {CORPUS}, k AS (SELECT {_FULL} AS a, {_MATN} AS b FROM corpus)
SELECT 'full' AS key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM k WHERE a <> '' GROUP BY a HAVING count(*) > 1) UNION ALL SELECT 'matn', CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM k WHERE b <> '' GROUP BY b HAVING count(*) > 1)""")
def _(s, d):
    return pf.duplicate_counts(corpus(s, d), {"full": tx.clean(F.col("en_full")), "matn": tx.clean(F.col("en_matn"))})


_CASES = {
    "full missing": "NOT f", "full missing, isnad and matn": "NOT f AND i AND m", "full missing, isnad only": "NOT f AND i AND NOT m", "full missing, matn only": "NOT f AND NOT i AND m", "full missing, none": "NOT f AND NOT i AND NOT m", "full rebuildable": "NOT f AND (i OR m)",
    "matn missing": "NOT m", "matn missing, full": "NOT m AND f", "matn missing, isnad": "NOT m AND i", "matn missing, full and isnad": "NOT m AND f AND i", "matn rebuildable": "NOT m AND f AND i AND rest",
    "isnad missing": "NOT i", "isnad missing, full": "NOT i AND f", "isnad missing, matn": "NOT i AND m", "isnad missing, full and matn": "NOT i AND f AND m", "isnad rebuildable": "NOT i AND f AND m AND start",
}


@query("f07_feasibility", f"""WITH {CORPUS}, c AS (SELECT {_FULL} AS a, {_ISNAD} AS b, {_MATN} AS e FROM corpus),
k AS (SELECT a <> '' AS f, b <> '' AS i, e <> '' AS m, a <> '' AND b <> '' AND starts_with(a, b) AND trim(substr(a, len(b) + 1)) <> '' AS rest, a <> '' AND e <> '' AND ends_with(a, e) AND trim(substr(a, 1, len(a) - len(e))) <> '' AS start FROM c)
""" + " UNION ALL ".join(f"SELECT '{name}' AS what, count(*) FILTER ({case}) AS n FROM k" for name, case in _CASES.items()))
def _(s, d):
    return pf.feasibility(corpus(s, d), "en_full", "en_isnad", "en_matn")


@query("f08_provenance", f"WITH {RECONSTRUCTED} SELECT part, value, count(*) AS n FROM (SELECT 'en_full_source' AS part, fs AS value FROM c6 UNION ALL SELECT 'en_isnad_source', isrc FROM c6 UNION ALL SELECT 'en_matn_source', ms FROM c6) GROUP BY ALL UNION ALL SELECT 'flag', 'has matn', count(*) FILTER (m <> '') FROM c6")
def _(s, d):
    rows = co.content_flags(co.reconstructed(corpus(s, d)))
    long = rows.unpivot(["id"], [f"en_{p}_source" for p in co.PARTS], "part", "value").groupBy("part", "value").agg(F.count("*").alias("n"))
    flags = pf.tally(rows, {"has matn": F.col("has_en_matn")})
    return long.unionByName(flags.select(F.lit("flag").alias("part"), F.col("what").alias("value"), "n"))


@query("f09_failure_samples", f"WITH {CORPUS}, l AS (SELECT 'no full' AS \"case\", id FROM corpus WHERE {_FULL} = '' UNION ALL SELECT 'no matn', id FROM corpus WHERE {_MATN} = '' UNION ALL SELECT 'no isnad', id FROM corpus WHERE {_ISNAD} = '') SELECT \"case\", id FROM l QUALIFY row_number() OVER (PARTITION BY \"case\" ORDER BY id) <= 5")
def _(s, d):
    cases = {f"no {p}": ~tx.has_text(F.col(f"en_{p}")) for p in co.PARTS}
    return pf.samples(corpus(s, d), cases, "id")


@query("f10_drop_audit", f"WITH {CORPUS}, l AS (SELECT id FROM corpus WHERE {_MATN} = '') SELECT id, (SELECT count(*) FROM l) AS n FROM l ORDER BY id LIMIT 20")
def _(s, d):
    _, gone = co.split_by(corpus(s, d).select("id", "en_matn"), tx.has_text(F.col("en_matn")))
    return gone.select("id").orderBy("id").limit(20).join(F.broadcast(gone.agg(F.count("*").alias("n"))))



