"""API-1 tag modes: what a search result carries besides its snippet.

Every result has the whole document text with its keyword highlighted
(HLT-1/2).  The mode then decides on tags:

  web             pre-tagged lists, document highlighted with class spans (HLT-7)
  web_new_pairs   dictionary tags, document and snippet with class spans (HLT-6),
                  new pairs and new targets (API-6)
  inline          dictionary tags, document and snippet with inline styles (HLT-6)
  email           pre-tagged lists, nothing highlighted
  pairs           dictionary tags, new pairs and new targets, nothing highlighted
  none            no tags

Tags are computed once per distinct document of the results and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curasift.functions import classify as cl
from curasift.functions import highlight as hl
from curasift.operators import pairs as pr
from curasift.operators import tagging as tg

MODES = ("web", "web_new_pairs", "inline", "email", "pairs", "none")
_STRINGS = "array<string>"


def tagged_text(document_type: Column, text: Column, keyword: Column) -> Column:
    """The document text with its keyword highlighted; as it is without one."""
    sub = document_type.isin(cl.SUBSCRIPTION_TYPES)
    return (F.when(keyword == "", text).when(sub, hl.highlight_keyword_subscriptions(text, keyword))
            .otherwise(hl.highlight_keyword(text, keyword)))


def _per_document(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """One sorted list of short strings per document (bounded by the dictionary)."""
    return rows.groupBy("doc_key").agg(F.array_sort(F.collect_set(value)).alias(name))


def tag_results(results: DataFrame, dictionary: DataFrame, known: DataFrame, mode: str) -> DataFrame:
    """``results`` (doc_key, document_type, keyword, document_text,
    shorter_sentences, ...) with tagged_document_text, entities_ordered,
    new_pairs and new_moas as the mode has them."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    out = results.withColumn("tagged_document_text", tagged_text(F.col("document_type"), F.col("document_text"), F.col("keyword")))
    empty = F.array().cast(_STRINGS)
    if mode == "none":
        return out.withColumns({c: empty for c in ("entities_ordered", "new_pairs", "new_moas")})
    docs = results.select("doc_key", "document_text").distinct()
    tags = tg.tag_entities(docs, dictionary)
    if mode in ("web", "email"):
        parsed = tg.parse_tag_lists(tg.tag_lists(tags))
        ranked = parsed.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("rank", "tag"))).alias("_e"))
        out = out.join(ranked.select("doc_key", F.transform("_e", lambda x: x["tag"]).alias("entities_ordered")), "doc_key", "left")
        if mode == "web":
            out = out.join(tg.highlight_list_input(parsed), "doc_key", "left")
            out = out.withColumn("tagged_document_text", hl.highlight_tags_from_list(F.col("tagged_document_text"), F.col("tag_list"))).drop("tag_list")
    else:
        out = out.join(tg.ordered_entities(tg.entity_summary(tags)), "doc_key", "left")
        if mode in ("web_new_pairs", "inline"):
            out = out.join(tg.highlight_tags_input(tags), "doc_key", "left")
            for c in ("tagged_document_text", "shorter_sentences"):
                out = out.withColumn(c, hl.highlight_tags(F.col(c), F.col("tags"), for_web=mode != "inline"))
            out = out.drop("tags")
    if mode in ("web_new_pairs", "pairs"):
        sp = pr.sentence_pairs(pr.sentence_entities(docs, dictionary, tags=tags))
        pairs = _per_document(pr.new_pairs(sp, known), "new_pairs", F.concat_ws("|", "moa", "indication"))
        moas = _per_document(pr.new_moas(sp, known), "new_moas", F.concat("moa", F.lit("|"), F.array_join("indications", ",")))
        out = out.join(pairs, "doc_key", "left").join(moas, "doc_key", "left")
    else:
        out = out.withColumns({"new_pairs": empty, "new_moas": empty})
    return out.withColumns({c: F.coalesce(F.col(c), empty) for c in ("entities_ordered", "new_pairs", "new_moas")})
