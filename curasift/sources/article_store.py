"""SRC-1 / FLT-1: the stored article table, one folder per modified date.

Parquet, ORC and JSON hold it (any file format with arrays).  A date range, or the
days of another table, prunes folders before a file is opened.  Writing a day again replaces
that day alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curasift.operators.joins import broadcast_if_small

#: The partition column; its value is the modified date.
DAY = "modified_date"

ARTICLE_SCHEMA = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("doc_id",)], T.StructField("doc_key", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("content", "title_txt")], T.StructField("file_modified_date", T.DateType()), T.StructField("pub_date", T.DateType()),
    *[T.StructField(c, T.StringType()) for c in ("journal_title", "journal_name", "article_title", "article_title_alt")],
    T.StructField("authors", T.ArrayType(T.StringType())), T.StructField("institutions", T.ArrayType(T.StringType())),
    *[T.StructField(c, T.StringType()) for c in ("exclusion_flag", "topic_class", "path0", "path_basename")]])


def write_articles(articles: DataFrame, path: str, format: str = "parquet") -> None:
    """Write or replace the days of ``articles``.  Rows are range-partitioned by day and key, so
    a day of any size is written by several tasks, and a task writes few days."""
    rows = articles.select(*ARTICLE_SCHEMA.names).withColumn(DAY, F.col("file_modified_date"))
    rows = rows.repartitionByRange(DAY, "doc_key").sortWithinPartitions(DAY, "doc_key")
    rows.write.format(format).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).save(path)


def read_articles(spark: SparkSession, path: str, from_date: str | None = None, to_date: str | None = None, format: str = "parquet") -> DataFrame:
    """The articles of the days from ``from_date`` to ``to_date`` (both included, either open)."""
    schema = T.StructType([*ARTICLE_SCHEMA.fields, T.StructField(DAY, T.DateType())])
    rows = spark.read.format(format).schema(schema).load(path)
    if from_date is not None:
        rows = rows.where(F.col(DAY) >= F.lit(from_date).cast("date"))
    if to_date is not None:
        rows = rows.where(F.col(DAY) <= F.lit(to_date).cast("date"))
    return rows.drop(DAY)


def articles_of_days(spark: SparkSession, path: str, days: DataFrame, format: str = "parquet") -> DataFrame:
    """The articles of the days listed in ``days`` (date); its rows prune the folders at run time."""
    schema = T.StructType([*ARTICLE_SCHEMA.fields, T.StructField(DAY, T.DateType())])
    rows = spark.read.format(format).schema(schema).load(path)
    listed = days.select(F.col("date").alias(DAY)).where(F.col(DAY).isNotNull()).distinct()
    return rows.join(broadcast_if_small(listed), DAY).drop(DAY)
