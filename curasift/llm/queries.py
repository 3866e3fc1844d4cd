"""Registered queries of this subpackage.  Each query reads its whole table, calls its
operator with production parameters and derives the result columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curasift.llm import chat_format, html_extract, lm_score, merkle, near_dup, periodic_runs, quality_rules, sharding, substring_dedup, subword, toxicity, url_filter
from curasift.llm import decontaminate as dc
from curasift.llm.common import ship_package
from curasift.llm.sql import oracle_sql
from curasift.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

#: The rules of the URL query, and the labels whose hosts are on its list.
URL_RULES = (url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"),
             url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "/fr/"))
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the keys (host and path) of all pages of hosts with a listed label."""
    pages = read_table(spark, sf_dir, "pages")
    host, path = url_filter.host_and_path(F.col("url"))
    listed = pages.select(host.alias("host"), path.alias("path")).where(F.col("host").rlike(rf"(^|\.)({'|'.join(LISTED_LABELS)})\.")).select(F.concat("host", "path").alias("key")).distinct()
    return url_filter.judge_urls(pages, URL_RULES, listed)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return dc.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("items")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = read_table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.fit(docs))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), shards=8)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return subword.encoding_report(read_table(spark, sf_dir, "documents"), subword.Vocabulary.load(subword.MODEL), k=2)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return substring_dedup.removal_report(read_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = chat_format.stale_reply_pairs(read_table(spark, sf_dir, "conversations"))
    return chat_format.format_preferences(chosen, rejected).withColumnRenamed("pair_id", "conv_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.learn(docs, read_table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), size=2, percent=80)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row claims its own leaf, but one in seven (by the CRC of its id) claims n_chars + 1."""
    ship_package(spark)
    docs = read_table(spark, sf_dir, "documents")
    tampered = [F.col(c) for c in ("doc_id", "source", "lang")] + [F.col("n_chars").cast("decimal(20,0)") + 1, F.col("text")]
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf(tampered))
    found = merkle.proofs(merkle.build(docs, claim=claim))
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", "verified")


def looped(key: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, or, for one id in ten, the words with a tail that repeats."""
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return periodic_runs.run_report(read_table(spark, sf_dir, "documents"), prepare=looped).drop("runs")


def op13_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return html_extract.page_texts(read_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_url_filters, op2_decontaminate, op3_lm_scoring, op4_sharding, op5_sentencepiece, op6_substring_dedup, op7_chat_format, op8_quality_rules, op9_toxicity, op10_near_dup, op11_merkle_manifest, op12_periodic_runs, op13_html_extract)}


__all__ = ["oracle_sql", "queries"]
