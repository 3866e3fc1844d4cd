"""Structured Streaming variant (an extension: the reference is a batch with a
date range).  The per-document transforms carry no cross-row state, so they
run unchanged on a ``readStream``; daily source counts become an event-time
window with a watermark, and the per-path first-wins rule becomes
``dropDuplicatesWithinWatermark``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curasift.functions import classify as cl
from curasift.session import ensure_checkpoint_dir
from curasift.sources import fixtures as fx
from curasift.sources.tables import SCHEMAS


def document_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The ``documents`` table as a file stream."""
    return (spark.readStream.schema(SCHEMAS["documents"]).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(f"{sf_dir.rstrip('/')}/documents*.parquet"))


def typed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming articles with type (CLS-1), FLT-3 applied and an event time
    (the modified date as a timestamp)."""
    a = fx.articles(spark, sf_dir, documents=document_stream(spark, sf_dir))
    a = a.where((F.col("doc_id") != "") & F.col("content").isNotNull() & F.col("exclusion_flag").isNull())
    t = cl.document_type(F.col("doc_id"))
    return (a.withColumn("document_type", t["document_type"]).withColumn("detailed_type", t["detailed_type"])
             .withColumn("event_ts", F.col("file_modified_date").cast("timestamp")))


def daily_source_counts(spark: SparkSession, sf_dir: str, watermark: str = "2 days") -> DataFrame:
    """AGG-7 as a watermarked one-day event-time window."""
    a = typed_articles(spark, sf_dir).withWatermark("event_ts", watermark)
    return a.groupBy(F.window("event_ts", "1 day"), "document_type").agg(F.count(F.lit(1)).alias("n"))


def unique_paths(spark: SparkSession, sf_dir: str, watermark: str = "2 days") -> DataFrame:
    """WIN-2 on a stream: first arrival of each path within the watermark."""
    a = typed_articles(spark, sf_dir).withWatermark("event_ts", watermark)
    return a.dropDuplicatesWithinWatermark(["doc_id"])


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame to completion (availableNow) into a parquet
    table under the shared checkpoint dir and read the table back.

    ``append`` uses the file sink (rows final once the watermark passes);
    ``complete`` rewrites the whole (small, aggregated) result table each
    micro-batch, so windows still open at the end of a finite input are
    included."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/curasift-stream/{name}-{uuid.uuid4().hex}"
    w = df.writeStream.option("checkpointLocation", base + "/chk").outputMode(mode).trigger(availableNow=True)
    if mode == "complete":
        w = w.foreachBatch(lambda b, _id: b.write.mode("overwrite").parquet(base + "/data"))
    else:
        w = w.format("parquet").option("path", base + "/data")
    w.start().awaitTermination()
    return spark.read.parquet(base + "/data")
