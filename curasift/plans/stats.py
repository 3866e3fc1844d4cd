"""Daily corpus statistics (API-3, AGG-6..11, SNK-2) for every day of a range
in one plan (the reference ran one day per call)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curasift.functions import classify as cl
from curasift.functions import text as tx
from curasift.operators import alerts as al
from curasift.operators import pairs as pr
from curasift.operators.tagging import tag_entities
from curasift.session import cut_lineage
from curasift.sources import known_store as ks

LINK_FROM, LINK_TO = "alert_document", "curate_alert_document"


def day_documents(articles: DataFrame, from_date, to_date) -> DataFrame:
    """Documents indexed on each day (match-all search of the day): FLT-1,
    FLT-3, PubMed floor at the day itself (FLT-4), first-wins title dedup per
    day (WIN-1), with type, title and path.  Metadata only: no text goes
    through the dedup (``with_texts`` adds it where it is read)."""
    a = al.skip_rows(articles.where(al.in_date_range(F.col("file_modified_date"), from_date, to_date)))
    a = al.classify(a.drop("content"))
    a = a.where(~F.col("document_type").isin(cl.PUBMED_TYPES) | F.col("pub_date").isNull()
                | (F.col("pub_date") >= F.col("file_modified_date")))
    a = al.first_per_title(a, ["file_modified_date"])
    return a.select("doc_key", "doc_id", F.col("file_modified_date").alias("date"), "document_type",
                    "detailed_type", "title",
                    F.replace(cl.redirect_path(F.col("doc_id"), al.REDIRECT_BASE), F.lit(LINK_FROM), F.lit(LINK_TO)).alias("path"))


def with_texts(days: DataFrame, articles: DataFrame) -> DataFrame:
    """The days' documents with their document text, which is made for them only."""
    found = days.select("doc_key", "date").join(articles.select("doc_key", "content"), "doc_key")
    return found.select("doc_key", "date", tx.document_text(F.col("content")).alias("document_text"))


def article_counts(days: DataFrame) -> DataFrame:
    """AGG-6."""
    return days.groupBy("date").agg(F.count(F.lit(1)).alias("indexed_article_count"))


def by_source(days: DataFrame, detailed: bool = False) -> DataFrame:
    """AGG-7 / AGG-8."""
    c = "detailed_type" if detailed else "document_type"
    return days.groupBy("date", c).agg(F.count(F.lit(1)).alias("n"))


def by_source_both(days: DataFrame) -> DataFrame:
    """AGG-7 and AGG-8 in one pass (GROUPING SETS)."""
    return (days.groupingSets([["date", "document_type"], ["date", "detailed_type"]], "date", "document_type", "detailed_type")
            .agg(F.count(F.lit(1)).alias("n")))


def day_tags(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """API-4 tags of the days' texts; the date is part of the tag key."""
    return tag_entities(texts, dictionary, ["doc_key", "date"])


def entity_counts(tags: DataFrame) -> DataFrame:
    """AGG-9 (documents with a valid tag of the entity) and AGG-10 (valid
    mentions) per day and entity."""
    return (tags.where("valid").groupBy("date", "entity_id")
            .agg(F.count_distinct("doc_key").alias("tagged_entity_count"),
                 F.count(F.lit(1)).alias("tagged_entity_count_repeat")))


def new_pair_lists(days: DataFrame, texts: DataFrame, tags: DataFrame, dictionary: DataFrame, known: DataFrame):
    """AGG-11: new (target, indication) pairs and new targets of each day,
    with the document link.  The sentence pairs are materialized once for both."""
    sp = cut_lineage(pr.sentence_pairs(pr.sentence_entities(texts, dictionary, tags=tags)))
    meta = days.select("doc_key", "date", "path")
    return (pr.new_pairs(sp, known).join(meta, "doc_key"),
            pr.new_moas(sp, known).join(meta, "doc_key"))


def daily_stats(days: DataFrame, articles: DataFrame, dictionary: DataFrame, known: DataFrame) -> DataFrame:
    """SNK-2 as one long table: (date, key, name, path, n), ``key`` being the
    reference's keys.  A day of any size is many rows, never one.  The tags are
    materialized once; counts, pairs and new targets read them."""
    days = cut_lineage(days)
    texts = with_texts(days, articles)
    tags = cut_lineage(day_tags(texts, dictionary))

    def rows(df: DataFrame, key: str, name, n, path=None) -> DataFrame:
        return df.select("date", F.lit(key).alias("key"), name.alias("name"),
                         (path if path is not None else F.lit(None).cast("string")).alias("path"), n.cast("long").alias("n"))
    ec = entity_counts(tags)
    pairs, moas = new_pair_lists(days, texts, tags, dictionary, known)
    one, none = F.lit(1), F.lit(None).cast("string")
    parts = [rows(article_counts(days), "indexed_article_count", none, F.col("indexed_article_count")),
             rows(by_source(days), "by_source", F.col("document_type"), F.col("n")),
             rows(by_source(days, True), "by_source_detail", F.col("detailed_type"), F.col("n")),
             rows(ec, "tagged_entity_count", F.col("entity_id"), F.col("tagged_entity_count")),
             rows(ec, "tagged_entity_count_repeat", F.col("entity_id"), F.col("tagged_entity_count_repeat")),
             rows(pairs, "new_moa_indication_pairs", F.concat_ws("|", "moa", "indication"), one, F.col("path")),
             rows(moas, "new_moas", F.concat("moa", F.lit("|"), F.array_join("indications", ",")), one, F.col("path"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_daily_stats(days: DataFrame, articles: DataFrame, dictionary: DataFrame, known: DataFrame, path: str) -> None:
    """SNK-2: the statistics as JSON lines in one folder per date.  The dates written are
    replaced, all others stay as they are; a date without a document has no statistics, and
    none are written for it."""
    out = daily_stats(days, articles, dictionary, known).withColumn("date_key", F.col("date").cast("string")).drop("date")
    order = ["date_key", "key", "name", "path"]
    (out.repartitionByRange(*order).sortWithinPartitions(*order)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date_key").json(path))


def period_pairs(articles: DataFrame, dictionary: DataFrame, from_date, to_date) -> DataFrame:
    """JN-8 of a period's documents: (doc_key, sent_no, moa, indication), materialized."""
    texts = with_texts(day_documents(articles, from_date, to_date), articles)
    return cut_lineage(pr.sentence_pairs(pr.sentence_entities(texts, dictionary, tags=cut_lineage(day_tags(texts, dictionary)))))


def learn_pairs(spark: SparkSession, articles: DataFrame, dictionary: DataFrame, store: str, version: int, from_date, to_date) -> DataFrame:
    """SRC-6 over time: the new pairs of a period against the known pairs before ``version``
    (doc_key, moa, indication); the period's pairs, those of new targets too, then
    become known as ``version``."""
    found = period_pairs(articles, dictionary, from_date, to_date)
    known = ks.read_known_pairs(spark, store, version - 1)
    fresh = cut_lineage(pr.new_pairs(found, known))
    ks.merge_known_pairs(spark, store, found, version)
    return fresh
