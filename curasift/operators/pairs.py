"""Target / indication pairs not yet known (API-6, JN-8/9/10, SET-5).

Per document, the keyword set is the lower-cased match texts of its *valid*
target and indication tags (type prefixes ``target`` / ``indication``: quirk
Q-13 fixed).  Those phrases are found again in every sentence of the
document text (case-insensitive, longest match); a sentence with at least
one target and one indication yields pairs (JN-8, all targets by all indications
of a (doc, sentence)).  Targets absent from ``known_pairs`` are new targets
(JN-9, anti join); known targets with an unknown indication are new pairs
(JN-10, semi + anti join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curasift.functions import text as tx
from curasift.operators.joins import broadcast_if_small, dealt_by_key
from curasift.operators.search import each_element
from curasift.operators.tagging import longest_spans, raw_spans, tag_entities


def sentence_entities(docs: DataFrame, dictionary: DataFrame, key: str = "doc_key",
                      text: str = "document_text", tags: DataFrame | None = None) -> DataFrame:
    """(key, sent_no, start, entity_id, kind) for target/indication keywords
    found in the sentences of each document that has valid tags of both kinds (no other can
    have a pair); ``tags`` are the documents' tags where the caller has them.  Without, the texts
    are dealt by key once: tags and sentences read them from the same exchange."""
    if tags is None:
        docs = dealt_by_key(docs.select(key, text), key)
        tags = tag_entities(docs, dictionary, key, text)
    kw = (tags.where(F.col("valid") & (F.col("type").startswith("target") | F.col("type").startswith("indication")))
          .groupBy(key, "phrase")
          .agg(F.min_by(F.struct("entity_id", "type"), "entity_id").alias("e"))
          .select(key, "phrase", F.col("e.entity_id").alias("entity_id"), F.col("e.type").alias("type")))
    # a document's keywords go with its text, if it has both kinds (no other can have a pair)
    has = lambda kind: F.max(F.col("type").startswith(kind).cast("int"))
    own = (kw.groupBy(key).agg(F.collect_list(F.struct("phrase", "entity_id", "type")).alias("_kw"), has("target").alias("t"), has("indication").alias("i"))
           .where("t = 1 and i = 1").select(key, "_kw"))
    sents = each_element(docs.join(own, key).select(key, "_kw", tx.text_to_sentences(F.col(text)).alias("_s")), "_s", "sent_no", "sentence").drop("_s")
    spans = raw_spans(sents, dictionary, [key, "sent_no", "_kw"], "sentence")
    spans = spans.withColumn("_e", F.get(F.filter("_kw", lambda k: k["phrase"] == F.col("phrase")), F.lit(0))).where(F.col("_e").isNotNull())
    spans = spans.select(key, "sent_no", "start", "end", F.col("_e.entity_id").alias("entity_id"), F.col("_e.type").alias("type"))
    spans = longest_spans(spans, [key, "sent_no"])
    kind = F.when(F.col("type").contains("target"), "target").when(F.col("type").contains("indication"), "indication")
    return spans.select(key, "sent_no", "start", "entity_id", kind.alias("kind"))


def sentence_pairs(sent_ents: DataFrame, key: str = "doc_key") -> DataFrame:
    """JN-8: distinct (doc, sentence, moa, indication)."""
    found = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.struct("entity_id")))
    # the entities of one sentence; a null key equals none
    both = (sent_ents.where(F.col(key).isNotNull() & F.col("sent_no").isNotNull())
            .groupBy(key, "sent_no").agg(found("target").alias("_t"), found("indication").alias("_i")))
    t = both.where((F.size("_t") > 0) & (F.size("_i") > 0)).select(key, "sent_no", F.explode("_t").alias("_t"), "_i")
    return (t.select(key, "sent_no", F.col("_t.entity_id").alias("moa"), F.explode("_i").alias("_i"))
            .select(key, "sent_no", "moa", F.col("_i.entity_id").alias("indication")))


def new_moas(pairs: DataFrame, known: DataFrame, key: str = "doc_key") -> DataFrame:
    """JN-9: targets not in the known table, with the sorted indications of
    the sentence where they were seen; distinct per document."""
    kb = broadcast_if_small(known.select("moa").distinct())
    unknown = pairs.join(kb, "moa", "left_anti")
    per_sent = unknown.groupBy(key, "sent_no", "moa").agg(F.array_sort(F.collect_set("indication")).alias("indications"))
    return per_sent.select(key, "moa", "indications").distinct()


def new_pairs(pairs: DataFrame, known: DataFrame, key: str = "doc_key") -> DataFrame:
    """JN-10: known targets paired with an indication not known for them."""
    kb = broadcast_if_small(known.select("moa").distinct())
    kp = broadcast_if_small(known.select("moa", "indication").distinct())
    return (pairs.join(kb, "moa", "left_semi").join(kp, ["moa", "indication"], "left_anti")
            .select(key, "moa", "indication").distinct())
