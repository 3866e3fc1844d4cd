"""A training-data pipeline over ``documents``: five stages, each by an operator of
``curasift.llm``, each written as Parquet and read again by the next.

1. toxicity: documents that the ordinal model finds toxic go.
2. near_duplicates: of each group of near copies (five-word shingles, Jaccard 0.8 or more) the
   document with the smallest id stays.
3. substring_dedup: words in 50-word windows that a document with a smaller id has too go; a
   document may be left with an empty text.
4. decontaminate: documents contaminated by ``benchmark`` go, and smaller hits are cut.
5. sentencepiece: each text's sampled segmentations, as piece ids with inclusion scores.

All stages but the last return the columns of their input.  An empty table passes through;
rows without an id or text stay, except where an operator's docstring says otherwise."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curasift.llm import decontaminate as dc
from curasift.llm import near_dup, substring_dedup, subword, toxicity
from curasift.llm.common import same_columns, ship_package
from curasift.session import ensure_checkpoint_dir
from curasift.sources.tables import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return same_columns(docs, near_dup.drop_near_duplicates(docs, size=5, percent=80))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return substring_dedup.remove_repeats(docs, width=50)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return dc.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), width=13, percent=5)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return subword.sample_encodings(docs, subword.Vocabulary.load(subword.MODEL), k=2)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", remove_repeats),
    ("decontaminate", decontaminate),
    ("sentencepiece", encode),
]

#: The learned model of stage 1 and the sampling of stage 5 are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them are in the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
