"""SRC-5 / SRC-6: the stored entity dictionary and the stored, versioned known pairs.

Known pairs only ever grow: version 0 is the initial table, and each merge adds one
version that holds the pairs not known before.  The state at a version is the union
of the versions up to it, a filter on the partition column.  Writing a version again
replaces that version alone, so a failed merge can be run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY_SCHEMA = "alias string, entity_id string, type string, preferred_label string, skos_pref string, label string, skos_alt string"
_PAIRS = "moa string, indication string, version int"


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    dictionary.select("alias", "entity_id", "type", "preferred_label", "skos_pref", "label", "skos_alt").write.mode("overwrite").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DICTIONARY_SCHEMA).parquet(path)


def _write(pairs: DataFrame, path: str, version: int) -> None:
    rows = pairs.select("moa", "indication").where("moa is not null and indication is not null").distinct().withColumn("version", F.lit(version))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def write_known_pairs(pairs: DataFrame, path: str) -> None:
    """Version 0."""
    _write(pairs, path, 0)


def read_known_pairs(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(moa, indication) known at ``version``, by default the latest."""
    rows = spark.read.schema(_PAIRS).parquet(path)
    return (rows if version is None else rows.where(F.col("version") <= version)).select("moa", "indication")


def merge_known_pairs(spark: SparkSession, path: str, pairs: DataFrame, version: int) -> None:
    """Write ``version``: those of ``pairs`` that no earlier version has."""
    earlier = read_known_pairs(spark, path, version - 1)
    _write(pairs.select("moa", "indication").join(earlier, ["moa", "indication"], "left_anti"), path, version)
