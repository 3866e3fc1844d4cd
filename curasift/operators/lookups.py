"""Lookups of single alerts, documents and companies (SRC-3, SRC-7, SRC-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curasift.functions import highlight as hl
from curasift.functions import text as tx
from curasift.operators import alerts as al
from curasift.operators import tagging as tg


def alert_by_id(alerts: DataFrame, alert_id: int) -> DataFrame:
    """SRC-3: the stored alert with this id (a filter that is pushed down)."""
    return alerts.where(F.col("alert_id") == alert_id)


def company_press_releases(articles: DataFrame, company: str, from_date=None, to_date=None) -> DataFrame:
    """SRC-8: press releases whose file name has the company's name, news-search
    ones left out, of an optional range of days; all of them, whatever their number."""
    found = articles.where(F.col("path_basename").contains(company) & (F.col("path0") == "Press releases")
                           & ~F.col("doc_id").contains("google_news_search"))
    if from_date is not None:
        found = found.where(F.col("file_modified_date") >= F.lit(from_date).cast("date"))
    if to_date is not None:
        found = found.where(F.col("file_modified_date") <= F.lit(to_date).cast("date"))
    return found


def document_view(articles: DataFrame, dictionary: DataFrame, paths: DataFrame) -> DataFrame:
    """SRC-7 + API-5 + HLT-7: the single-document view for every requested
    path (``paths``: a DataFrame with ``doc_id``; an equi-join, not a scan
    per path): document text with its tagged entities highlighted."""
    a = al.skip_rows(articles.join(paths.select("doc_id").distinct(), "doc_id", "left_semi"))
    d = a.select("doc_key", "doc_id", tx.document_text(F.col("content")).alias("document_text"))
    p = tg.parse_tag_lists(tg.tag_lists(tg.tag_entities(d.select("doc_key", "document_text"), dictionary)))
    return (d.join(tg.highlight_list_input(p), "doc_key", "left")
            .select("doc_id", hl.highlight_tags_from_list(F.col("document_text"), F.col("tag_list")).alias("tagged_text")))
