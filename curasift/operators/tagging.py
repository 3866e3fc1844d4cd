"""Dictionary tagging (API-4/5, JN-3, WIN-5, FLT-7/8, AGG-2/3/4, TOP-1/2,
CLS-2/3).

Aliases are matched on whole tokens, case-insensitively, by the same token
join as the search (``phrase_occurrences``); the dictionary side is a
size-checked broadcast.  A tag is a token span [start, end) of the tagged
text with every dictionary entity whose alias normalizes to that span.
Spans contained in another span are dropped (longest match, NO_SUB), then
only entities of the relevant dictionaries are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curasift.functions import classify as cl
from curasift.functions import text as tx
from curasift.operators.joins import broadcast_if_small
from curasift.operators.search import phrase_occurrences

TYPE_LISTS = [("drug", "drug_tags"), ("target", "target_tags"), ("company", "company_tags"),
              ("indication", "indication_tags")]
# The type given to entities parsed from each pre-tagged list.
LIST_TYPES = {"drug_tags": "drug_OME_txt_ss", "target_tags": "target_OME_txt_ss",
              "company_tags": "company_OME_txt_ss", "indication_tags": "indication_OME2_txt_ss"}


def dictionary_entities(dictionary: DataFrame) -> DataFrame:
    """SRC-5 + CLS-3: (alias_norm, entity_id, type, label)."""
    return dictionary.select(
        tx.phrase_norm(F.col("alias")).alias("phrase"), "entity_id", "type",
        cl.entity_label("preferred_label", "skos_pref", "label", "skos_alt", "entity_id").alias("label"))


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def longest_spans(spans: DataFrame, key) -> DataFrame:
    """WIN-5: drop a span when an earlier-starting (or same-start, longer)
    span of the same text reaches at least as far (no contained spans)."""
    w = (Window.partitionBy(*_keys(key)).orderBy(F.col("start"), F.col("end").desc())
         .rowsBetween(Window.unboundedPreceding, -1))
    return (spans.withColumn("_reach", F.max("end").over(w))
                 .where(F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_reach"))


def raw_spans(docs: DataFrame, dictionary: DataFrame, key="doc_key",
              text: str = "document_text") -> DataFrame:
    """JN-3: (key..., start, end, match_text, phrase) of every alias occurrence."""
    ents = dictionary_entities(dictionary)
    occ = phrase_occurrences(docs, ents.select("phrase"), key, text, with_text=True)
    return occ.select(*_keys(key), "start", (F.col("start") + F.col("n")).alias("end"), "match_text", "phrase")


def tag_spans(docs: DataFrame, dictionary: DataFrame, key="doc_key",
              text: str = "document_text") -> DataFrame:
    """JN-3 + WIN-5: longest-match spans of any dictionary alias (all
    dictionaries take part in the overlap rule, as in the tagger)."""
    return longest_spans(raw_spans(docs, dictionary, key, text), key)


def tag_entities(docs: DataFrame, dictionary: DataFrame, key="doc_key",
                 text: str = "document_text") -> DataFrame:
    """API-4 tags: one row per (tag, relevant entity): key, start, end,
    match_text, phrase, entity_id, type, label, valid (FLT-7 on the
    entity's type)."""
    ents = broadcast_if_small(dictionary_entities(dictionary)
                              .where(F.col("type").isin(cl.RELEVANT_DICTIONARIES)))  # FLT-8
    t = tag_spans(docs, dictionary, key, text).join(ents, "phrase")
    return t.select(*_keys(key), "start", "end", "match_text", "phrase", "entity_id", "type", "label",
                    cl.tag_is_valid(F.col("match_text"), F.col("type")).alias("valid"))


def entity_summary(tags: DataFrame, key: str = "doc_key") -> DataFrame:
    """AGG-2: per (doc, entity): type, match texts / validity / offsets in text
    order, tag_count, tag_count_cleaned, first position."""
    return (tags.groupBy(key, "entity_id", "type", "label")
            .agg(F.sort_array(F.collect_list(F.struct("start", "end", "match_text", "valid"))).alias("_t"),
                 F.count(F.lit(1)).alias("tag_count"),
                 F.count_if(F.col("valid")).alias("tag_count_cleaned"),
                 F.min("start").alias("first_start"))
            .select(key, "entity_id", "type", "label", "tag_count", "tag_count_cleaned", "first_start",
                    F.transform("_t", lambda x: x["match_text"]).alias("match_texts"),
                    F.transform("_t", lambda x: x["valid"]).alias("valid_flags"),
                    F.transform("_t", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("offsets"),
                    cl.overall_tag_type(F.array("type")).alias("overall_type")))


def match_histogram(tags: DataFrame, key: str = "doc_key") -> DataFrame:
    """AGG-3: per (doc, entity, match text) count."""
    return tags.groupBy(key, "entity_id", "match_text").agg(F.count(F.lit(1)).alias("n"))


def ordered_entities(summary: DataFrame, by: str = "tag_count_cleaned", key: str = "doc_key") -> DataFrame:
    """TOP-1/TOP-2: entity ids of a document by ``by`` desc, ties by first
    appearance then id."""
    return (summary.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct((-F.col(by)).alias("o"), "first_start", "entity_id")))
                 .alias("_e"))
            .select(key, F.transform("_e", lambda x: x["entity_id"]).alias("entities_ordered")))


def tag_lists(tags: DataFrame, key: str = "doc_key") -> DataFrame:
    """Pre-tagged list columns ('entity\\tmatch text' per tag, text order) by
    overall type, as the index stores them (SET-4 input)."""
    t = tags.withColumn("_kind", cl.overall_tag_type(F.array("type")))
    g = t.groupBy(key).agg(*[
        F.sort_array(F.collect_list(F.when(F.col("_kind") == kind,
                                           F.struct("start", "entity_id", "match_text")))).alias(col)
        for kind, col in TYPE_LISTS])
    return g.select(key, *[F.transform(col, lambda x: F.concat(x["entity_id"], F.lit("\t"), x["match_text"])).alias(col)
                           for _, col in TYPE_LISTS])


def parse_tag_lists(df: DataFrame, key: str = "doc_key") -> DataFrame:
    """API-5 / AGG-4 / SET-4: the four typed lists (missing = empty) ->
    one row per (doc, entity): type of first appearance, match texts in list
    order, rank by number of match texts desc then first appearance (TOP-1)."""
    def entries(n, col):
        typ = LIST_TYPES[col]
        return F.transform(F.coalesce(F.col(col), F.array().cast("array<string>")),
                           lambda s, i: F.struct(F.lit(n).alias("list_no"), i.alias("pos"), s.alias("s"),
                                                 F.lit(typ).alias("type")))
    parts = [entries(n, col) for n, (_, col) in enumerate(TYPE_LISTS)]
    x = df.select(key, F.explode(F.concat(*parts)).alias("e"))
    x = x.select(key, "e.list_no", "e.pos", "e.type",
                 F.regexp_replace(F.split_part(F.col("e.s"), F.lit("\t"), F.lit(1)), "[^\\x00-\\x7F]", "").alias("tag"),
                 F.split_part(F.col("e.s"), F.lit("\t"), F.lit(2)).alias("match_text"))
    g = (x.groupBy(key, "tag")
         .agg(F.min_by("type", F.struct("list_no", "pos")).alias("type"),
              F.min(F.struct("list_no", "pos")).alias("first"),
              F.sort_array(F.collect_list(F.struct("list_no", "pos", "match_text"))).alias("_m")))
    g = g.select(key, "tag", "type", "first", F.transform("_m", lambda m: m["match_text"]).alias("match_texts"))
    w = Window.partitionBy(key).orderBy(F.size("match_texts").desc(), F.col("first"))
    return g.withColumn("rank", F.row_number().over(w))


def highlight_list_input(parsed: DataFrame, key: str = "doc_key") -> DataFrame:
    """HLT-7 input: per doc, (match_text, type) of every entity's match texts,
    entities in first-appearance order."""
    e = parsed.select(key, "first", F.transform("match_texts", lambda m, i: F.struct(
        i.alias("i"), m.alias("match_text"), F.col("type").alias("type"))).alias("ms"))
    g = e.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("first", "ms"))).alias("_e"))
    return g.select(key, F.flatten(F.transform("_e", lambda x: F.transform(
        x["ms"], lambda m: F.struct(m["match_text"].alias("match_text"), m["type"].alias("type"))))).alias("tag_list"))


def highlight_tags_input(tags: DataFrame, key: str = "doc_key") -> DataFrame:
    """HLT-6 input: per doc, (match_text, first entity type) of every relevant
    tag in text order."""
    first = (tags.groupBy(key, "start", "end", "match_text")
             .agg(F.min_by("type", "entity_id").alias("type")))
    g = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "match_text", "type"))).alias("_t"))
    return g.select(key, F.transform("_t", lambda t: F.struct(t["match_text"].alias("match_text"),
                                                             t["type"].alias("type"))).alias("tags"))
