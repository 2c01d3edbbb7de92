"""The registered queries of the thirteen operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, exact_topk, html_extract, license_scan, mixing, near_dup, prefix_trie, quality, rule_ledger, sharding, spelling, url_filter
from .common import stored, table


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page."""
    return url_filter.judge(table(spark, folder, "pages"), url_filter.fit(url_filter.labelled(spark)))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, license, containment, first_word of every license notice found."""
    return license_scan.scan(table(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return html_extract.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digests of every conversation, read back from its formatted windows."""
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digests(chat_format.windows(turns))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, lang, topic, tokens, p, kept of every document."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "embeddings"))


def op7_decontam(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, item_id, covered, cosine of every leak of a benchmark item."""
    return decontam.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, class_id: near-duplicate class of every document."""
    return near_dup.near_duplicates(table(spark, folder, "documents"))


def op9_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, rank, vec_id, score: the five best rows of every query."""
    return exact_topk.top_k(table(spark, folder, "embeddings"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, shard, version of every document, from the committed manifest."""
    return sharding.sharded(table(spark, folder, "documents")).select("doc_id", "shard", "version")


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements, failed rules and the current policy's verdict on every document, from the stored ledger."""
    rows = stored(rule_ledger.ledger(table(spark, folder, "documents")), "ledger")
    return rule_ledger.judged(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word of the documents."""
    return spelling.variants(table(spark, folder, "documents").select("doc_id", "text"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, folder, "conversations")))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that ``corpus_pipeline.run`` keeps and the shards they are in."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_url_filter, op2_license_scan, op3_quality, op4_html_extract, op5_chat_format,
        op6_mixing, op7_decontam, op8_near_dup, op9_exact_topk, op10_sharding,
        op11_quality_rules, op12_spelling_variants, op13_prefix_trie, pipeline,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan.oracle(), "op6_mixing": mixing.oracle(), "op9_exact_topk": exact_topk.oracle(),
            "op11_quality_rules": rule_ledger.oracle(), "op12_spelling_variants": spelling.oracle(), "op13_prefix_trie": prefix_trie.oracle()}
