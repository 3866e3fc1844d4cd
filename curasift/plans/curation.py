"""The curation job (API-7/8/9, FLT-5/6, PRJ-5..7, SCR-1/2, JN-2, WIN-6, SNK-1).

One lazy plan for all owners and all their alerts; the only action is the
sink.  The reference ran three nested serial loops and one score query per
document; here scores are a left join and owners are rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curasift.functions import classify as cl
from curasift.operators.alerts import keyword_label, run_alerts
from curasift.operators.joins import broadcast_if_small

# CSV header of the curation file and the annotation links.
CURATION_HEADER = ["Query context", "Keyword (count)", "Document Type | Title | Tagged Sentence",
                   "Curation", "Document Link"]
CURATION_COLUMNS = ["query_context", "keyword_counts", "type_title_sentence", "curation",
                    "document_link"]
ANNOTATE_BASE = "https://curation.invalid/annotate"


def source_filter(df: DataFrame) -> DataFrame:
    """FLT-5: drop Cortellis drug-status full e-mails and clinical-trial types."""
    d = F.col("doc_id")
    cort = (d.contains("Cortellis") | d.contains("cortellis")) & d.contains("Drug_Status_Changes_alert") \
        & d.contains("full_email")
    ct = F.col("document_type").contains("clinical_trials")
    return df.where(~(cort | ct))


def emailed_alerts(alerts: DataFrame, owner_like: str | None = None,
                   title_like: str | None = None) -> DataFrame:
    """SRC-2 + FLT-6: alerts of an owner / title pattern with e-mail on."""
    a = alerts.where(F.col("email") == "yes")
    if owner_like:
        a = a.where(F.col("owner").like(owner_like))
    if title_like:
        a = a.where(F.col("alert_title").like(title_like))
    return a


def latest_scores(scores: DataFrame) -> DataFrame:
    """WIN-6: one score row per document (latest processed, then lowest id),
    as a map-side-combined ``min_by`` (no per-document window)."""
    cols = [c for c in scores.columns if c != "doc_key"]
    order = F.struct((-F.unix_micros(F.col("processed_dt"))).alias("t"), F.col("id").alias("i"))
    return (scores.groupBy("doc_key").agg(F.min_by(F.struct(*cols), order).alias("_r"))
            .select("doc_key", "_r.*").select(*scores.columns))


def attach_scores(df: DataFrame, scores: DataFrame, user_col: str = "owner",
                  base: str = ANNOTATE_BASE) -> DataFrame:
    """API-7 (JN-2, SCR-1, SCR-2): relevance label and feedback links.  The
    score table grows with the corpus, so this is a plain left join (sort-merge
    or AQE-chosen), not a forced broadcast."""
    s = latest_scores(scores).select("doc_key", F.col("id").alias("score_id"), "score")
    out = df.join(s, "doc_key", "left")
    user = cl.owner_name(F.col(user_col))
    link = lambda kind: F.when(F.col("score_id").isNotNull(), F.concat(
        F.lit(base + "/"), user, F.lit("/"), F.col("score_id").cast("string"), F.lit("/" + kind))).otherwise(F.lit(""))
    return (out.withColumn("relevant_check", cl.score_label("score"))
               .withColumn("correct_link", link("correct"))
               .withColumn("wrong_link", link("wrong")))


def curation_rows(articles: DataFrame, alerts: DataFrame, from_date, to_date,
                  owner_like: str | None = None, title_like: str | None = None) -> DataFrame:
    """API-8/9: curation rows for all alerts (of an owner, if given)."""
    a = broadcast_if_small(emailed_alerts(alerts, owner_like, title_like))
    r = source_filter(run_alerts(articles, a, from_date, to_date))
    user = cl.owner_name(F.col("owner"))
    title = cl.short_title(F.col("title"))
    return r.select(
        F.col("alert_title").alias("query_context"),
        keyword_label(F.col("keyword_list")).alias("keyword_counts"),
        F.concat_ws(" | ", F.col("document_type"), title, F.col("shorter_sentences")).alias("type_title_sentence"),
        F.lit("NA").alias("curation"),
        cl.curation_link(F.col("path"), user).alias("document_link"),
    )


def write_curation_csv(rows: DataFrame, path: str) -> None:
    """SNK-1: UTF-8 CSV with the reference's header, no index column."""
    out = rows.select(*[F.col(c).alias(h) for c, h in zip(CURATION_COLUMNS, CURATION_HEADER)])
    (out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_curation_csv(spark, path: str) -> DataFrame:
    """Read a curation CSV written by ``write_curation_csv`` back (snake-case
    columns)."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(h, T.StringType()) for h in CURATION_HEADER])
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return df.select(*[F.col(f"`{h}`").alias(c) for c, h in zip(CURATION_COLUMNS, CURATION_HEADER)])


