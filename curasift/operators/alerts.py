"""Alert expansion and the alert run (ALT-1/2, API-2, FLT-1..4, FLT-10/11,
WIN-1/2, AGG-5, SET-1/2/3/6, JN-4..7, JN-11).

All alerts and all their aliases are one plan: alerts are expanded into
search parameters (a small table), matched against the documents by the
token join of ``operators.search``, enriched per hit with Column expressions,
deduplicated with windows / ``min_by`` and merged per (alert, document).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curasift.functions import classify as cl
from curasift.functions import fuzzy
from curasift.functions import highlight as hl
from curasift.functions import snippets as sn
from curasift.functions import text as tx
from curasift.operators.joins import broadcast_if_small
from curasift.operators.search import each_element, search_hits

PARAM_COLUMNS = ["alert_id", "alias_seq", "search_type", "keyphrase1", "keyphrase2",
                 "keyphrase_distance", "keyword", "owner", "source_select", "alert_title",
                 "filter_type", "journal_select", "author_select", "institution_select",
                 "filter_leeway"]
REDIRECT_BASE = "https://curation.invalid/alert_document/<user_name>/"


def _split_list(c: Column) -> Column:
    """SET-3: ', '-separated list, empties removed, first occurrence kept."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), ", ", -1), lambda x: x != ""))


def expand_alerts(alerts: DataFrame) -> DataFrame:
    """ALT-1: one row per search of an alert (alias order: own keyword first,
    then alias position -- quirk Q-7).
      standard        keyword + aliases (an alias string shorter than 2 is ignored)
      standard_title  aliases only
      cooccurence[_N] keyword with each alias, optional distance N
    """
    t = F.col("alert_type")
    aliases = F.coalesce(F.col("aliases"), F.lit(""))
    std = F.when(F.length(aliases) >= 2,
                 F.concat(F.array(F.col("keyword")), F.split(aliases, ", ", -1))
                 ).otherwise(F.array(F.col("keyword")))
    terms = (F.when(t == "standard", std)
             .when(t == "standard_title", F.split(aliases, ", ", -1))
             .when(F.contains(t, F.lit("cooccurence")), F.split(aliases, ", ", -1))
             .otherwise(F.array().cast("array<string>")))
    terms = F.array_distinct(F.filter(terms, lambda x: x != ""))
    cooc = F.contains(t, F.lit("cooccurence"))
    dist = F.when(cooc & (F.size(F.split(t, "_")) > 1), F.get(F.split(t, "_"), 1).try_cast("int"))
    x = alerts.select("*", F.posexplode(terms).alias("alias_seq", "term"))
    return x.select(
        "alert_id", "alias_seq",
        F.when(cooc, F.lit("cooccurence")).otherwise(F.lit("standard")).alias("search_type"),
        F.when(cooc, F.col("keyword")).otherwise(F.col("term")).alias("keyphrase1"),
        F.when(cooc, F.col("term")).alias("keyphrase2"),
        dist.alias("keyphrase_distance"),
        F.col("term").alias("keyword"),
        "owner", "source_select", "alert_title", "filter_type",
        F.coalesce("journal_select", F.lit("")).alias("journal_select"),
        F.coalesce("author_select", F.lit("")).alias("author_select"),
        F.coalesce("institution_select", F.lit("")).alias("institution_select"),
        F.coalesce("filter_leeway", F.lit(70)).alias("filter_leeway"),
    )


def keyword_lists(alerts: DataFrame) -> DataFrame:
    """ALT-2: search keywords (keyword unless standard_title, then the
    ','-split aliases, stripped) and the title keyword list."""
    al = F.when(F.coalesce(F.col("aliases"), F.lit("")) != "",
                F.transform(F.split("aliases", ",", -1), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
    kws = F.when(F.col("alert_type") == "standard_title", al).otherwise(F.concat(F.array("keyword"), al))
    return alerts.select("alert_id", kws.alias("keywords"), F.array("keyword").alias("title_keywords"))


def source_matches(path0: Column, basename: Column, source_select: Column) -> Column:
    """FLT-2: 'all', or any listed source: 'Ct.gov' is the CT.gov basename
    prefix, any other value the top folder."""
    srcs = F.split(F.coalesce(source_select, F.lit("all")), ", ", -1)
    one = F.exists(srcs, lambda s: F.when(s == "Ct.gov", basename.startswith("CT.gov-added_or_modified_studies"))
                   .otherwise(path0 == s))
    return (F.coalesce(source_select, F.lit("all")) == "all") | one


def in_date_range(col: Column, from_date, to_date) -> Column:
    """FLT-1: whole days from..to (the end date is honoured: Q-4 fixed)."""
    return (col >= F.lit(from_date).cast("date")) & (col <= F.lit(to_date).cast("date"))


def skip_rows(df: DataFrame) -> DataFrame:
    """FLT-3: empty id, no content, exclusion flag present."""
    return df.where((F.col("doc_id") != "") & F.col("content").isNotNull() & F.col("exclusion_flag").isNull())


def pub_date_floor(doc_type: Column, pub_date: Column, from_date) -> Column:
    """FLT-4: PubMed documents published before from_date are dropped; an
    unparsable (NULL) date keeps the document."""
    return (~doc_type.isin(cl.PUBMED_TYPES)) | pub_date.isNull() | (pub_date >= F.lit(from_date).cast("date"))


def first_per_key(df: DataFrame, keys: list[str], order: str = "doc_key") -> DataFrame:
    """First row (smallest ``order``) per key as an aggregation: ``min_by``
    is combined map-side, so a hot key (one title shared by a third of the
    corpus) reaches the shuffle as one row per map task, never as a whole
    group in one task as a window would."""
    cols = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
    return g.select(*keys, "_r.*").select(*df.columns)


def first_per_title(df: DataFrame, search_keys: list[str]) -> DataFrame:
    """WIN-1: first-wins dedup by raw title inside one search, in index order
    (document key).  Rows whose display title differs from the raw title are
    not deduplicated (quirk Q-5): their own key takes part in the grouping."""
    plain = (F.col("title") != F.col("title_txt")) | F.col("title_txt").isNull()
    own = df.withColumn("_own", F.when(F.coalesce(plain, F.lit(False)), F.col("doc_key")))
    return first_per_key(own, [*search_keys, "title_txt", "_own"]).drop("_own")


def doc_texts(articles: DataFrame, hits: DataFrame) -> DataFrame:
    """Per-document text columns, computed once per *hit* document (not per
    hit, not for documents no alert matched): document text (TXT-4), the
    masked text lower-cased (for AGG-1) and the masked sentences (for SNP-*);
    MSK-1 or MSK-2 by document type (SNP-3)."""
    keys = hits.select("doc_key", "document_type").distinct()
    d = articles.select("doc_key", "content").join(keys, "doc_key")
    sub = F.col("document_type").isin(cl.SUBSCRIPTION_TYPES)
    d = d.withColumn("document_text", tx.document_text(F.col("content"))).drop("content")
    d = d.withColumn("_masked", F.when(sub, tx.mask_special("document_text", False))
                     .otherwise(tx.mask_special("document_text", True)))
    return (d.withColumn("masked_lower", F.lower("_masked"))
             .withColumn("sentences", tx.text_to_sentences(F.col("_masked")))
             .drop("_masked", "document_type"))


def _keyword_cols(df: DataFrame, keyword: Column) -> DataFrame:
    sub = F.col("document_type").isin(cl.SUBSCRIPTION_TYPES)
    df = df.withColumn("keyword", F.trim(keyword))
    return df.withColumn("_kwl", F.lower(F.when(sub, tx.mask_special("keyword", False))
                                        .otherwise(tx.mask_special("keyword", True))))


def with_counts(hits: DataFrame) -> DataFrame:
    """AGG-1 per hit; ``hits`` has the document's ``masked_lower`` and ``_kwl``."""
    return hits.withColumn("keyword_count", F.when(F.col("keyword") == "", F.lit(0))
                           .otherwise(tx.count_whole_word(F.col("masked_lower"), F.col("_kwl"))))


def with_snippets(hits: DataFrame, only: Column | None = None) -> DataFrame:
    """SNP-3 + HLT-1/2 per hit (where ``only`` holds) from the document's
    ``sentences``; an empty keyword gives no snippet and the whole text as
    tagged text."""
    only = F.lit(True) if only is None else only
    sub = F.col("document_type").isin(cl.SUBSCRIPTION_TYPES)
    h = hits.withColumn("sentences", F.when(only, F.col("sentences")))
    h = sn.with_snippet_from_sentences(h, "sentences", "_kwl", sub, "snippet")
    h = h.withColumn("snippet", F.when(F.col("keyword") == "", F.lit("")).otherwise(F.col("snippet")))
    tagged = F.when(sub, hl.highlight_keyword_subscriptions("snippet", "keyword")) \
              .otherwise(hl.highlight_keyword("snippet", "keyword"))
    tagged = F.when(F.col("keyword") == "", F.col("document_text")).otherwise(tagged)
    return h.withColumn("shorter_sentences", F.when(only, tagged)).drop("sentences")


def enrich(hits: DataFrame, articles: DataFrame, keyword: Column, only: Column | None = None) -> DataFrame:
    """API-1 per-hit enrichment: keyword count for every hit; snippet,
    highlighted snippet and document text where ``only`` holds (everywhere by
    default).  The hits meet their document's texts in one join."""
    h = _keyword_cols(hits.join(doc_texts(articles, hits), "doc_key"), keyword)
    h = with_snippets(with_counts(h).drop("masked_lower"), only).drop("_kwl")
    return h if only is None else h.withColumn("document_text", F.when(only, F.col("document_text")))


def classify(df: DataFrame) -> DataFrame:
    t = cl.document_type(F.col("doc_id"))
    return (df.withColumn("document_type", t["document_type"])
              .withColumn("detailed_type", t["detailed_type"])
              .withColumn("title", cl.display_title("document_type", "title_txt", "journal_title",
                                                    "article_title", "article_title_alt", "journal_name")))


# ---------------------------------------------------------------------------
# Metadata filters (JN-4..7, FLT-10/11, SET-1/2)
# ---------------------------------------------------------------------------

#: letter, alert column with the patterns, and the value column of each metadata filter.
_FILTERS = (("j", "journal_select"), ("a", "author_select"), ("i", "institution_select"))


def _named(items: Column, f: str, name: str) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(f).alias("f"), x.alias(name)))


def _metadata_values(hits: DataFrame) -> DataFrame:
    """(alert_id, doc_key, f, value): the journal, author and institution values of each
    PubMed hit."""
    journal = F.array(F.coalesce("journal_title", "journal_name"))
    values = {"j": journal, "a": F.col("authors"), "i": F.col("institutions")}
    none = F.array().cast("array<string>")
    listed = F.concat(*[_named(F.when(F.col(c) != "", values[f]).otherwise(none), f, "value") for f, c in _FILTERS])
    base = hits.where(F.col("document_type").isin(cl.PUBMED_TYPES)).select("alert_id", "doc_key", "journal_title", "journal_name", "authors", "institutions", *[c for _, c in _FILTERS]).distinct()
    return base.select("alert_id", "doc_key", F.explode(listed).alias("v")).select("alert_id", "doc_key", "v.f", "v.value").where(F.col("value").isNotNull())


def _metadata_patterns(hits: DataFrame) -> DataFrame:
    """(alert_id, f, pattern, filter_leeway) of the alerts that have hits."""
    listed = F.concat(*[_named(_split_list(F.col(c)), f, "pattern") for f, c in _FILTERS])
    base = hits.select("alert_id", "filter_leeway", *[c for _, c in _FILTERS]).distinct()
    return base.select("alert_id", "filter_leeway", F.explode(listed).alias("p")).select("alert_id", "p.f", "p.pattern", "filter_leeway").distinct()


def metadata_candidates(hits: DataFrame) -> DataFrame:
    """All (alert_id, doc_key, filter_leeway, f, pattern, value): each PubMed hit's values
    against its own alert's patterns."""
    return _metadata_values(hits).join(broadcast_if_small(_metadata_patterns(hits)), ["alert_id", "f"]).select("alert_id", "doc_key", "filter_leeway", "f", "pattern", "value")


def fuzzy_pairs(cands: DataFrame) -> DataFrame:
    """FUZ-1 on distinct (value, pattern) pairs only."""
    return cands.select("value", "pattern").distinct().withColumn("score", fuzzy.ratio("pattern", "value"))


def possible_pairs(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """(alert_id, f, value, pattern, filter_leeway): the pairs of an alert's values (alert_id, f, value) and
    patterns (alert_id, f, pattern, filter_leeway) whose ratio can be above the leeway.  Exact:
    both sides are blocked on the tokens of their prefixes, of which such pairs share one, then
    lengths and common characters are compared; no other pair is scored."""
    limits = patterns.groupBy("alert_id", "f", "filter_leeway").agg(F.lit(1).alias("_1")).drop("_1")
    v = values.select("alert_id", "f", "value").distinct().withColumn("vt", fuzzy.character_tokens(F.col("value")))
    v = v.join(broadcast_if_small(limits), ["alert_id", "f"])
    v = each_element(v.withColumn("_t", fuzzy.prefix_tokens(F.col("vt"), F.col("filter_leeway"))), "_t", "_i", "tok").drop("_t", "_i")
    p = patterns.withColumn("pt", fuzzy.character_tokens(F.col("pattern")))
    p = each_element(p.withColumn("_t", fuzzy.prefix_tokens(F.col("pt"), F.col("filter_leeway"))), "_t", "_i", "tok").drop("_t", "_i")
    both = v.join(broadcast_if_small(p), ["alert_id", "f", "filter_leeway", "tok"])
    la, lb, leeway = F.size("pt"), F.size("vt"), F.col("filter_leeway")
    fits = fuzzy.could_exceed(F.least(la, lb), la, lb, leeway) & fuzzy.could_exceed(F.size(F.array_intersect("pt", "vt")), la, lb, leeway)
    return both.where(fits).select("alert_id", "f", "value", "pattern", "filter_leeway").distinct()


def metadata_flags(hits: DataFrame) -> DataFrame:
    """JN-4/5/6: per (alert, doc) which of journal / author / institution
    filters matched (score > leeway, strict: FLT-10)."""
    values = _metadata_values(hits)
    possible = possible_pairs(values, _metadata_patterns(hits))
    matched = (possible.join(fuzzy_pairs(possible), ["value", "pattern"])
               .where(F.col("score") > F.col("filter_leeway")).select("alert_id", "f", "value").distinct())
    return (values.join(matched, ["alert_id", "f", "value"])
            .groupBy("alert_id", "doc_key")
            .agg(F.max((F.col("f") == "j").cast("int")).alias("j"),
                 F.max((F.col("f") == "a").cast("int")).alias("a"),
                 F.max((F.col("f") == "i").cast("int")).alias("i")))


def with_meta_pass(hits: DataFrame, literal_and: bool = False) -> DataFrame:
    """``meta_pass`` on every hit row: does the document pass the alert's
    journal / author / institution filters?  Fuzzy ratios are computed once per
    distinct (value, pattern) pair and joined back (equi-join), never per hit.

    Alerts with no select pass everything.  PubMed-only: other documents
    never pass a set filter (FLT-11).  'and' intersects the three sets; by
    default an unset select does not take part (Q-6 fixed); literal_and=True
    reproduces the original (unset select = empty set = nothing passes)."""
    flags = metadata_flags(hits)
    b = hits.join(flags, ["alert_id", "doc_key"], "left").fillna(0, ["j", "a", "i"])
    js, as_, is_ = (F.col("journal_select") != ""), (F.col("author_select") != ""), (F.col("institution_select") != "")
    j, a, i = (F.col("j") == 1), (F.col("a") == 1), (F.col("i") == 1)
    and_ok = (j & a & i) if literal_and else ((j | ~js) & (a | ~as_) & (i | ~is_))
    any_sel = js | as_ | is_
    pub = F.col("document_type").isin(cl.PUBMED_TYPES)
    ok = F.when(~any_sel, F.lit(True)).when(F.col("filter_type") == "and", and_ok).otherwise(j | a | i)
    return b.withColumn("meta_pass", ok & (pub | ~any_sel)).drop("j", "a", "i")


def metadata_pass(hits: DataFrame, literal_and: bool = False) -> DataFrame:
    """(alert_id, doc_key, meta_pass) of the hits, once each."""
    return with_meta_pass(hits, literal_and).select("alert_id", "doc_key", "meta_pass").distinct()


# ---------------------------------------------------------------------------
# The alert run
# ---------------------------------------------------------------------------

HIT_DOC_COLUMNS = ["doc_key", "doc_id", "title_txt", "file_modified_date", "pub_date", "journal_title",
                   "journal_name", "article_title", "article_title_alt", "authors", "institutions",
                   "topic_class", "path0", "path_basename"]


def alert_hits(articles: DataFrame, alerts: DataFrame, from_date, to_date) -> DataFrame:
    """Search + per-search filters + WIN-1: one narrow row per (alert, alias,
    doc) -- document metadata only, no text, so the dedup shuffles stay small."""
    params = broadcast_if_small(expand_alerts(alerts))
    docs = skip_rows(articles.where(in_date_range(F.col("file_modified_date"), from_date, to_date)))
    keys = ["alert_id", "alias_seq"]
    found = search_hits(docs.select("doc_key", "content"), params, keys)
    h = (found.join(params, keys)
         .join(docs.select(*HIT_DOC_COLUMNS), "doc_key")
         .where(source_matches(F.col("path0"), F.col("path_basename"), F.col("source_select"))))
    h = classify(h).where(pub_date_floor(F.col("document_type"), F.col("pub_date"), from_date))
    return first_per_title(h, keys)


def run_alerts(articles: DataFrame, alerts: DataFrame, from_date, to_date,
               link_base: str = REDIRECT_BASE, literal_and: bool = False,
               materialize: bool = True) -> DataFrame:
    """API-2: every alert with every alias, merged per (alert, document):
    the first alias (in alias order) whose hit passes the metadata filter
    wins (WIN-2); ``keyword_list`` lists every alias that hit the document,
    by count desc, ties in alias order (AGG-5; collected before the metadata
    filter, quirk Q-23).

    Plan: narrow hits (checkpointed once into the shared checkpoint dir when
    ``materialize``: they feed the fuzzy flags, the text join and the merge)
    -> meta flags -> winner per (alert, doc) by a window on narrow rows ->
    one join with the per-document texts: counts for every hit, snippet and
    highlight only for the winner -> one (alert, doc) aggregation."""
    hits = alert_hits(articles, alerts, from_date, to_date)
    if materialize:
        from curasift.session import cut_lineage
        hits = cut_lineage(hits)
    h = with_meta_pass(hits, literal_and)
    w = Window.partitionBy("alert_id", "doc_id")
    h = h.withColumn("_win", F.col("alias_seq") == F.min(F.when(F.col("meta_pass"), F.col("alias_seq"))).over(w))
    win = F.coalesce(F.col("_win"), F.lit(False))
    h = (enrich(h, articles, F.col("keyword"), win)
          .withColumn("path", cl.redirect_path(F.col("doc_id"), link_base))
          .withColumn("topic_class", cl.topic_class("topic_class")))
    keep = ["alias_seq", "keyword", "keyword_count", "doc_key", "file_modified_date", "title",
            "document_text", "document_type", "detailed_type", "snippet", "shorter_sentences",
            "topic_class", "path", "alert_title", "owner", "filter_type"]
    # the winner column by column: a column that the caller doesn't read is not made or shuffled
    # (an aggregate of one struct would hold them all)
    g = (h.groupBy("alert_id", "doc_id")
         .agg(*[F.min_by(c, F.when(win, F.col("alias_seq"))).alias(c) for c in keep],
              F.max(F.col("meta_pass").cast("int")).alias("_any"),
              F.sort_array(F.collect_list(F.struct((-F.col("keyword_count")).alias("neg"), "alias_seq",
                                                   F.col("keyword").alias("kw"),
                                                   F.col("keyword_count").alias("n")))).alias("_kws")))
    return (g.where(F.col("_any") == 1)
             .select("alert_id", "doc_id", *keep,
                     F.transform("_kws", lambda s: F.struct(s["kw"].alias("kw"), s["n"].alias("n")))
                     .alias("keyword_list")))


def keyword_label(keyword_list: Column) -> Column:
    """ALT-3: 'kw (n), kw (n)'."""
    return F.array_join(F.transform(keyword_list, lambda k: F.concat(k["kw"], F.lit(" ("),
                                                                     k["n"].cast("string"), F.lit(")"))), ", ")


def default_window(today: _dt.date | None = None, days: int = 15):
    """DAT-1: look-back window today-15 .. today."""
    t = today or _dt.date.today()
    return t - _dt.timedelta(days=days), t
