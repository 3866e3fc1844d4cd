"""QRY-6 / TOP-5 from an index: a postings table written once, which ranked searches read
instead of the texts.

``postings`` has one row per (token, document) with the token's count and the document's
length, in folders by token hash and sorted by token within files, so a search opens
the folders of its tokens only and, in those, the row groups that can hold them.  Files are
cut by ranges of (token, document): a token that every document has fills several files.
``corpus`` has one row: the number of documents and of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curasift.functions import text as tx
from curasift.operators.joins import MAX_BROADCAST_BYTES, estimated_bytes
from curasift.operators.search import bm25_ranked, each_element

BUCKETS = 64


def _bucket(w: Column) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")


def write_postings(docs: DataFrame, path: str, key: str = "doc_key", text: str = "content") -> None:
    """Index all of ``docs``; documents without a text have no tokens but count as documents."""
    lists = docs.select(F.col(key).alias("doc_key"), F.coalesce(tx.tokens(F.col(text)), F.array().cast("array<string>")).alias("_t"))
    lists.agg(F.count(F.lit(1)).alias("N"), F.sum(F.size("_t")).alias("tokens")).write.mode("overwrite").parquet(f"{path}/corpus")
    each = each_element(lists.withColumn("dl", F.size("_t")), "_t", "_pos", "w")
    rows = each.groupBy("w", "doc_key", "dl").agg(F.count(F.lit(1)).alias("tf")).withColumn("bucket", _bucket(F.col("w")))
    order = ["bucket", "w", "doc_key"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def read_postings(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """The postings of ``terms`` (w).  Terms within the broadcast bound prune folders and row
    groups; more are joined."""
    rows = spark.read.schema("w string, doc_key long, dl int, tf long, bucket int").parquet(f"{path}/postings")
    terms = terms.select("w").distinct().withColumn("bucket", _bucket(F.col("w")))
    if estimated_bytes(terms) > MAX_BROADCAST_BYTES:
        return rows.join(terms, ["bucket", "w"]).drop("bucket")
    found = terms.collect()  # bounded as a broadcast is
    return rows.where(F.col("bucket").isin(sorted({r.bucket for r in found})) & F.col("w").isin(sorted(r.w for r in found))).drop("bucket")


def search_postings(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """As ``search.bm25_top_k`` over the indexed documents: query_id, doc_key, score, rank."""
    q = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("query")))).alias("w"))
    corpus = spark.read.schema("N long, tokens long").parquet(f"{path}/corpus").select("N", (F.col("tokens") / F.col("N")).alias("avgdl"))
    return bm25_ranked(read_postings(spark, path, q), corpus, q, k, "doc_key")
