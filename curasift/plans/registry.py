"""
DuckDB oracle texts.  Every query reads the shared tables through
``sources.fixtures`` so its work grows with the data; the inline alerts,
dictionary and known pairs are configuration applied to those tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curasift.checks import oracles as orc
from curasift.checks import sqlfrag as sq
from curasift.functions import classify as cl
from curasift.functions import text as tx
from curasift.operators import alerts as al
from curasift.operators import lookups
from curasift.operators import postings as po
from curasift.operators.joins import broadcast_if_small, dealt_by_key
from curasift.operators.search import each_element, search_hits
from curasift.plans import curation as cu
from curasift.session import cut_lineage
from curasift.sources import article_store as ar
from curasift.sources import fixtures as fx
from curasift.sources import known_store as ks

FROM, TO = orc.RANGE
KEYS = ["alert_id", "alias_seq"]
_Q: dict[str, tuple] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        _Q[name] = (fn, sql)
        return fn
    return deco


def queries():
    return {k: v[0] for k, v in _Q.items()}


def oracle_sql():
    return {k: v[1] for k, v in _Q.items() if v[1] is not None}


def _arts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.articles(spark, sf)


def _emailed(spark):
    return fx.alerts(spark).where(F.col("email") == "yes")


def _docs(spark, sf):
    return al.skip_rows(_arts(spark, sf).where(al.in_date_range(F.col("file_modified_date"), FROM, TO)))


def _raw_hits(spark, sf, alerts=None):
    params = al.expand_alerts(alerts if alerts is not None else fx.alerts(spark))
    return search_hits(_docs(spark, sf).select("doc_key", "content"), params, KEYS), params


# ---------------------------------------------------------------------------
# Curation job (flagship) and alert pipeline stages
# ---------------------------------------------------------------------------

@register("api_9_curation_all_owners", orc.curation_sql())
def q_api_9_curation(spark, sf):
    return cu.curation_rows(_arts(spark, sf), fx.alerts(spark), FROM, TO)


@register("api_8_curation_of_owner", orc.curation_sql("email = 'yes' and owner like '%ana.lee%'"))
def q_api_8_curation(spark, sf):
    return cu.curation_rows(_arts(spark, sf), fx.alerts(spark), FROM, TO, owner_like="%ana.lee%")


@register("jn_1_alias_document_hits", orc.alert_pipeline_sql(
    "select alert_id, alias_seq, doc_key from found0", "true"))
def q_jn_1(spark, sf):
    return _raw_hits(spark, sf)[0]


def _typed_hits(spark, sf, cond):
    h, p = _raw_hits(spark, sf)
    return h.join(p.where(cond), KEYS).select("alert_id", "alias_seq", "doc_key")


@register("qry_1_phrase_search", orc.alert_pipeline_sql(
    "select alert_id, alias_seq, doc_key from found0 where keyphrase2 is null", "true"))
def q_qry_1(spark, sf):
    return _typed_hits(spark, sf, F.col("keyphrase2").isNull())


@register("qry_2_cooccurrence_search", orc.alert_pipeline_sql(
    "select alert_id, alias_seq, doc_key from found0 where keyphrase2 is not null and keyphrase_distance is null", "true"))
def q_qry_2(spark, sf):
    return _typed_hits(spark, sf, F.col("keyphrase2").isNotNull() & F.col("keyphrase_distance").isNull())


@register("qry_3_proximity_search", orc.alert_pipeline_sql(
    "select alert_id, alias_seq, doc_key from found0 where keyphrase_distance is not null", "true"))
def q_qry_3(spark, sf):
    return _typed_hits(spark, sf, F.col("keyphrase_distance").isNotNull())


@register("alt_1_search_params", orc.alert_pipeline_sql(
    """select p.alert_id, p.alias_seq, p.keyphrase1, p.keyphrase2, p.keyphrase_distance, p.keyword,
         coalesce(c.n, 0) as n_hits
       from params p left join (select alert_id, alias_seq, count(*) as n from found0 group by all) c
       using (alert_id, alias_seq)""", "true"))
def q_alt_1(spark, sf):
    h, p = _raw_hits(spark, sf)
    n = h.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_hits"))
    return (p.join(n, KEYS, "left").fillna(0, ["n_hits"])
            .select(*KEYS, "keyphrase1", "keyphrase2", "keyphrase_distance", "keyword", "n_hits"))


@register("src_2_alert_scan_of_owner", orc.alert_pipeline_sql(
    """select a.alert_id, a.keyword, a.alert_type, coalesce(c.n, 0) as n_docs
       from alerts_in a left join (select alert_id, count(distinct doc_key) as n from found0 group by all) c
       using (alert_id)""", "owner like '%ben.ng%' and alert_title like 'NEWS%'"))
def q_src_2(spark, sf):
    a = fx.alerts(spark).where(F.col("owner").like("%ben.ng%") & F.col("alert_title").like("NEWS%"))
    h, _ = _raw_hits(spark, sf, a)
    n = h.groupBy("alert_id").agg(F.count_distinct("doc_key").alias("n_docs"))
    return a.join(n, "alert_id", "left").fillna(0, ["n_docs"]).select("alert_id", "keyword", "alert_type", "n_docs")


@register("flt_2_source_selection", orc.alert_pipeline_sql(
    "select alert_id, alias_seq, doc_key, path0 from found", "true"))
def q_flt_2(spark, sf):
    h, p = _raw_hits(spark, sf)
    d = _docs(spark, sf).select("doc_key", "path0", "path_basename")
    return (h.join(p, KEYS).join(d, "doc_key")
            .where(al.source_matches(F.col("path0"), F.col("path_basename"), F.col("source_select")))
            .select(*KEYS, "doc_key", "path0"))


@register("flt_4_pub_date_floor", orc.alert_pipeline_sql(
    "select alert_id, alias_seq, doc_key, document_type, title from titled", "true"))
def q_flt_4(spark, sf):
    h = _hits_before_dedup(spark, sf)
    return h.select(*KEYS, "doc_key", "document_type", "title")


def _hits_before_dedup(spark, sf, alerts=None):
    params = broadcast_if_small(al.expand_alerts(alerts if alerts is not None else fx.alerts(spark)))
    docs = _docs(spark, sf)
    found = search_hits(docs.select("doc_key", "content"), params, KEYS)
    h = (found.join(params, KEYS).join(docs, "doc_key")
         .where(al.source_matches(F.col("path0"), F.col("path_basename"), F.col("source_select"))))
    return al.classify(h).where(al.pub_date_floor(F.col("document_type"), F.col("pub_date"), FROM))


@register("win_1_title_dedup", orc.alert_pipeline_sql(
    "select alert_id, alias_seq, doc_key, title_txt from hits", "true"))
def q_win_1(spark, sf):
    return al.alert_hits(_arts(spark, sf), fx.alerts(spark), FROM, TO).select(*KEYS, "doc_key", "title_txt")


def _hits_email(spark, sf):
    """Narrow alert hits of the e-mailed alerts (no text work), checkpointed
    once: the metadata filters read them in several branches."""
    from curasift.session import cut_lineage
    return cut_lineage(al.alert_hits(_arts(spark, sf), _emailed(spark), FROM, TO))


def _enriched(spark, sf):
    return al.enrich(_hits_email(spark, sf), _arts(spark, sf), F.col("keyword"))


@register("agg_1_keyword_mentions", orc.alert_pipeline_sql(
    "select alert_id, alias_seq, doc_key, kw as keyword, keyword_count from e1"))
def q_agg_1(spark, sf):
    return _enriched(spark, sf).select(*KEYS, "doc_key", "keyword", "keyword_count")


@register("snp_3_keyword_snippet", orc.alert_pipeline_sql(
    "select alert_id, alias_seq, doc_key, document_type, snippet from e1"))
def q_snp_3(spark, sf):
    return _enriched(spark, sf).select(*KEYS, "doc_key", "document_type", "snippet")


@register("hlt_1_highlight_keyword", orc.alert_pipeline_sql(
    "select alert_id, alias_seq, doc_key, shorter_sentences from e2"))
def q_hlt_1(spark, sf):
    return _enriched(spark, sf).select(*KEYS, "doc_key", "shorter_sentences")


@register("flt_10_metadata_filter", orc.alert_pipeline_sql(
    "select distinct alert_id, doc_key, meta_pass from meta where any_sel"))
def q_flt_10(spark, sf):
    e = _hits_email(spark, sf)
    m = al.metadata_pass(e)
    sel = e.select("alert_id", ((F.col("journal_select") != "") | (F.col("author_select") != "")
                                | (F.col("institution_select") != "")).alias("any_sel")).distinct()
    return m.join(sel.where("any_sel"), "alert_id").select("alert_id", "doc_key", "meta_pass")


@register("api_2_alert_results", orc.alert_pipeline_sql(
    """select alert_id, doc_id, alias_seq, kw as keyword, keyword_count, document_type, title,
         keyword_list_label from merged"""))
def q_api_2(spark, sf):
    r = al.run_alerts(_arts(spark, sf), _emailed(spark), FROM, TO)
    return r.select("alert_id", "doc_id", "alias_seq", "keyword", "keyword_count", "document_type", "title",
                    al.keyword_label(F.col("keyword_list")).alias("keyword_list_label"))


@register("win_2_first_alias_per_path", orc.alert_pipeline_sql(
    "select alert_id, doc_id, alias_seq from merged"))
def q_win_2(spark, sf):
    r = al.run_alerts(_arts(spark, sf), _emailed(spark), FROM, TO)
    return r.select("alert_id", "doc_id", "alias_seq")


@register("agg_5_keyword_list", orc.alert_pipeline_sql(
    "select alert_id, doc_id, keyword_list_label from merged"))
def q_agg_5(spark, sf):
    r = al.run_alerts(_arts(spark, sf), _emailed(spark), FROM, TO)
    return r.select("alert_id", "doc_id", al.keyword_label(F.col("keyword_list")).alias("keyword_list_label"))


@register("flt_5_source_post_filter", orc.alert_pipeline_sql(
    """select alert_id, doc_id, document_type from merged
       where not ((contains(doc_id, 'Cortellis') or contains(doc_id, 'cortellis')) and contains(doc_id, 'Drug_Status_Changes_alert') and contains(doc_id, 'full_email'))
         and not contains(document_type, 'clinical_trials')"""))
def q_flt_5(spark, sf):
    r = cu.source_filter(al.run_alerts(_arts(spark, sf), _emailed(spark), FROM, TO))
    return r.select("alert_id", "doc_id", "document_type")


# ---------------------------------------------------------------------------
# Per-document text functions over the whole corpus
# ---------------------------------------------------------------------------

def _doc_q(name, spark_expr, sql_expr):
    @register(name, f"select doc_id, {sql_expr('text')} as v from documents")
    def q(spark, sf):
        from curasift.sources.tables import read_table
        return read_table(spark, sf, "documents").select("doc_id", spark_expr(F.col("text")).alias("v"))
    return q


_doc_q("txt_1_line_break_cleaning", tx.clean_line_breaks, sq.clean_line_breaks)
_doc_q("txt_4_document_text", tx.document_text, sq.document_text)
_doc_q("msk_1_mask_special", tx.mask_special, sq.mask_special)
_doc_q("msk_2_mask_special_subscriptions", lambda c: tx.mask_special(c, False),
       lambda e: sq.mask_special(e, False))
_doc_q("sec_1_section_marks", tx.mark_sections, sq.mark_sections)
_doc_q("flt_9_wanted_sections", lambda c: tx.keep_sections(tx.mark_sections(c)),
       lambda e: sq.keep_sections(sq.mark_sections(e)))
_doc_q("agg_1_whole_word_count_the", lambda c: tx.count_whole_word(F.lower(c), F.lit("the")),
       lambda e: sq.count_whole_word(f"lower({e})", "'the'"))


@register("txt_3_split_sentences", f"""select doc_id, generate_subscripts(s, 1) - 1 as sent_no, unnest(s) as sentence
  from (select doc_id, {sq.split_sentences('text', False)} as s from documents)""")
def q_txt_3(spark, sf):
    from curasift.sources.tables import read_table
    d = read_table(spark, sf, "documents")
    return each_element(d.select("doc_id", tx.split_sentences(F.col("text"), keep_tail=False).alias("_s")), "_s", "sent_no", "sentence").drop("_s")


@register("txt_2_text_to_sentences", f"""select doc_id, generate_subscripts(s, 1) - 1 as sent_no, unnest(s) as sentence
  from (select doc_id, {sq.text_to_sentences('text')} as s from documents)""")
def q_txt_2(spark, sf):
    from curasift.sources.tables import read_table
    d = read_table(spark, sf, "documents")
    return each_element(d.select("doc_id", tx.text_to_sentences(F.col("text")).alias("_s")), "_s", "sent_no", "sentence").drop("_s")


# ---------------------------------------------------------------------------
# Sources, projections, classification, filters over the articles view
# ---------------------------------------------------------------------------

_T, _D = orc.doc_type_case("doc_id")


@register("src_1_document_scan", orc.articles_query(
    """select doc_id, doc_key, title_txt, file_modified_date, pub_date, journal_title, authors,
         institutions, exclusion_flag, topic_class, path0, path_basename, length(content) as n_chars
       from articles"""))
def q_src_1(spark, sf):
    return _arts(spark, sf).select("doc_id", "doc_key", "title_txt", "file_modified_date", "pub_date",
                                   "journal_title", "authors", "institutions", "exclusion_flag",
                                   "topic_class", "path0", "path_basename",
                                   F.length("content").alias("n_chars"))


@register("cls_1_document_type", orc.articles_query(
    f"select doc_id, {_T} as document_type, {_D} as detailed_type from articles"))
def q_cls_1(spark, sf):
    t = cl.document_type(F.col("doc_id"))
    return _arts(spark, sf).select("doc_id", t["document_type"].alias("document_type"),
                                   t["detailed_type"].alias("detailed_type"))


@register("fmt_2_display_type", orc.articles_query(
    f"select doc_id, {sq.display_type(_T)} as display_type from articles"))
def q_fmt_2(spark, sf):
    t = cl.document_type(F.col("doc_id"))
    return _arts(spark, sf).select("doc_id", tx.display_type(t["document_type"]).alias("display_type"))


@register("prj_1_display_title", orc.articles_query(
    f"select doc_id, {orc.display_title(_T)} as title from articles"))
def q_prj_1(spark, sf):
    a = al.classify(_arts(spark, sf))
    return a.select("doc_id", "title")


@register("prj_3_topic_class", orc.articles_query(
    "select doc_id, coalesce(topic_class, 'Not Evaluated') as topic_class from articles"))
def q_prj_3(spark, sf):
    return _arts(spark, sf).select("doc_id", cl.topic_class("topic_class").alias("topic_class"))


@register("prj_4_redirect_link", orc.articles_query(
    f"select doc_id, {orc.redirect_path('doc_id')} as path from articles"))
def q_prj_4(spark, sf):
    return _arts(spark, sf).select("doc_id", cl.redirect_path(F.col("doc_id"), al.REDIRECT_BASE).alias("path"))


@register("prj_5_curation_link", orc.articles_query(
    f"select doc_id, {orc.curation_link(orc.redirect_path('doc_id'), sq.q('ana.lee'))} as link from articles"))
def q_prj_5(spark, sf):
    p = cl.redirect_path(F.col("doc_id"), al.REDIRECT_BASE)
    return _arts(spark, sf).select("doc_id", cl.curation_link(p, F.lit("ana.lee")).alias("link"))


@register("prj_6_short_title", orc.articles_query(
    f"select doc_id, {orc.short_title('path_basename')} as short_title from articles"))
def q_prj_6(spark, sf):
    return _arts(spark, sf).select("doc_id", cl.short_title(F.col("path_basename")).alias("short_title"))


@register("prj_8_path_parts", orc.articles_query(
    "select doc_id, path0, path_basename, file_modified_date from articles"))
def q_prj_8(spark, sf):
    return _arts(spark, sf).select("doc_id", "path0", "path_basename", "file_modified_date")


@register("fmt_1_sanitize_title", orc.articles_query(
    f"select doc_id, {sq.sanitize_title('title_txt')} as clean_title from articles"))
def q_fmt_1(spark, sf):
    return _arts(spark, sf).select("doc_id", tx.sanitize_title(F.col("title_txt")).alias("clean_title"))


@register("flt_1_date_range", orc.articles_query(
    """select file_modified_date, count(*) as n from articles
       where file_modified_date between date '2024-01-05' and date '2024-01-12' group by all"""))
def q_flt_1(spark, sf):
    """Over the article store: only the folders of the range's days are read."""
    path = _sink_path(spark, "articles")
    ar.write_articles(_arts(spark, sf), path)
    return ar.read_articles(spark, path, "2024-01-05", "2024-01-12").groupBy("file_modified_date").agg(F.count(F.lit(1)).alias("n"))


@register("src_1_article_store", orc.articles_query(
    """select doc_id, doc_key, file_modified_date, pub_date, journal_title, authors, institutions, topic_class, length(content) as n_chars
       from articles where file_modified_date in (date '2024-01-03', date '2024-01-20')"""))
def q_src_1_store(spark, sf):
    """Two days, given as a table, of the article store kept as ORC."""
    path = _sink_path(spark, "articles-orc")
    ar.write_articles(_arts(spark, sf), path, "orc")
    days = spark.sql("select explode(array(date '2024-01-03', date '2024-01-20')) as date")
    a = ar.articles_of_days(spark, path, days, "orc")
    return a.select("doc_id", "doc_key", "file_modified_date", "pub_date", "journal_title", "authors", "institutions", "topic_class", F.length("content").alias("n_chars"))


@register("dat_1_lookback_window", orc.articles_query(
    """select file_modified_date, count(*) as n from articles
       where file_modified_date between date '2024-01-15' and date '2024-01-30' group by all"""))
def q_dat_1(spark, sf):
    import datetime as dt
    f, t = al.default_window(dt.date(2024, 1, 30))
    a = _arts(spark, sf).where(al.in_date_range(F.col("file_modified_date"), f.isoformat(), t.isoformat()))
    return a.groupBy("file_modified_date").agg(F.count(F.lit(1)).alias("n"))


@register("flt_3_skip_rows", orc.articles_query(
    "select doc_id from articles where doc_id <> '' and content is not null and exclusion_flag is null"))
def q_flt_3(spark, sf):
    return al.skip_rows(_arts(spark, sf)).select("doc_id")


@register("src_8_company_press_releases", orc.articles_query(
    f"""select doc_id, doc_key from articles
        where contains(path_basename, 'Acme') and path0 = 'Press releases' and not contains(doc_id, 'google_news_search')
        and file_modified_date between date '2024-01-01' and date '2024-01-30'"""))
def q_src_8(spark, sf):
    return lookups.company_press_releases(_arts(spark, sf), "Acme", FROM, TO).select("doc_id", "doc_key")


@register("src_3_alert_by_id", orc.alert_pipeline_sql(
    "select alert_id, alias_seq, keyphrase1, keyphrase2, doc_key from found0", "alert_id = 2"))
def q_src_3(spark, sf):
    """SRC-3: one stored alert looked up by its id, with the documents it finds."""
    h, p = _raw_hits(spark, sf, lookups.alert_by_id(fx.alerts(spark), 2))
    return h.join(p, KEYS).select(*KEYS, "keyphrase1", "keyphrase2", "doc_key")


# ---------------------------------------------------------------------------
# Scores (JN-2, WIN-6, SCR-1/2, API-7)
# ---------------------------------------------------------------------------

_SCORE_SQL = f"""with {fx.articles_sql()}, {fx.scores_sql()},
s1 as (select * exclude (rn) from (select *, row_number() over (partition by doc_key order by processed_dt desc, id) as rn from scores) where rn = 1)
select a.doc_key,
  case when s.score is null then 'No Eval'
       when s.score > 0.5 then 'Relevant (' || printf('%.1f', round_even(s.score * 100.0, 0)) || '%)'
       else 'NR (' || printf('%.1f', round_even(s.score * 100.0, 0)) || '%)' end as relevant_check,
  case when s.id is null then '' else '{cu.ANNOTATE_BASE}/ana.lee/' || cast(s.id as varchar) || '/correct' end as correct_link,
  case when s.id is null then '' else '{cu.ANNOTATE_BASE}/ana.lee/' || cast(s.id as varchar) || '/wrong' end as wrong_link
from articles a left join s1 s using (doc_key)"""


@register("api_7_attach_scores", _SCORE_SQL)
def q_api_7(spark, sf):
    a = _arts(spark, sf).select("doc_key", F.lit("CORP\\ana.lee").alias("owner"))
    return cu.attach_scores(a, fx.scores(spark, sf)).select("doc_key", "relevant_check", "correct_link", "wrong_link")


@register("scr_1_score_label", f"select doc_key, relevant_check from ({_SCORE_SQL})")
def q_scr_1(spark, sf):
    return q_api_7(spark, sf).select("doc_key", "relevant_check")


# ---------------------------------------------------------------------------
# Tagging (JN-3, WIN-5, FLT-7/8, AGG-2/3/4, TOP-1/2, CLS-2/3/4, SET-4, HLT-6/7)
# ---------------------------------------------------------------------------

from curasift.functions import highlight as hl  # noqa: E402
from curasift.operators import pairs as pr  # noqa: E402
from curasift.operators import tagging as tg  # noqa: E402
from curasift.plans import stats as st  # noqa: E402


def _tag_docs(spark, sf):
    a = al.skip_rows(_arts(spark, sf))
    return a.select("doc_key", tx.document_text(F.col("content")).alias("document_text"))


def _tags(spark, sf):
    return tg.tag_entities(_tag_docs(spark, sf), fx.dictionary(spark))


@register("jn_3_dictionary_tags", orc.tags_query(
    'select doc_key, start, "end", match_text, entity_id, type, valid from tags'))
def q_jn_3(spark, sf):
    return _tags(spark, sf).select("doc_key", "start", "end", "match_text", "entity_id", "type", "valid")


@register("win_5_longest_match_spans", orc.tags_query('select doc_key, start, "end", match_text from d_long'))
def q_win_5(spark, sf):
    return tg.tag_spans(_tag_docs(spark, sf), fx.dictionary(spark)).select("doc_key", "start", "end", "match_text")


@register("flt_7_tag_validity", orc.tags_query(
    "select match_text, type, valid, count(*) as n from tags group by all"))
def q_flt_7(spark, sf):
    return _tags(spark, sf).groupBy("match_text", "type", "valid").agg(F.count(F.lit(1)).alias("n"))


@register("flt_8_relevant_dictionaries", orc.tags_query(
    "select type, count(*) as n from tags group by all"))
def q_flt_8(spark, sf):
    return _tags(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


_SUMMARY_SQL = """select doc_key, entity_id, type, label, count(*) as tag_count,
    count_if(valid) as tag_count_cleaned, min(start) as first_start,
    list(match_text order by start, "end", match_text, valid) as match_texts,
    list(valid order by start, "end", match_text, valid) as valid_flags
  from tags group by doc_key, entity_id, type, label"""


@register("agg_2_entity_summary", orc.tags_query(
    f"select doc_key, entity_id, type, tag_count, tag_count_cleaned, match_texts, valid_flags from ({_SUMMARY_SQL})"))
def q_agg_2(spark, sf):
    return tg.entity_summary(_tags(spark, sf)).select(
        "doc_key", "entity_id", "type", "tag_count", "tag_count_cleaned", "match_texts", "valid_flags")


@register("agg_3_match_histogram", orc.tags_query(
    "select doc_key, entity_id, match_text, count(*) as n from tags group by all"))
def q_agg_3(spark, sf):
    return tg.match_histogram(_tags(spark, sf))


@register("top_2_entities_by_valid_count", orc.tags_query(
    f"""select doc_key, list(entity_id order by tag_count_cleaned desc, first_start, entity_id) as entities_ordered
        from ({_SUMMARY_SQL}) group by doc_key"""))
def q_top_2(spark, sf):
    return tg.ordered_entities(tg.entity_summary(_tags(spark, sf)), "tag_count_cleaned")


@register("top_1_entities_by_match_count", orc.tags_query(
    f"""select doc_key, list(entity_id order by tag_count desc, first_start, entity_id) as entities_ordered
        from ({_SUMMARY_SQL}) group by doc_key"""))
def q_top_1(spark, sf):
    return tg.ordered_entities(tg.entity_summary(_tags(spark, sf)), "tag_count")


def _overall_sql(t):
    return (f"case when contains({t}, 'indication') then 'indication' when contains({t}, 'target') then 'target' "
            f"when contains({t}, 'company') then 'company' when contains({t}, 'drug') then 'drug' "
            f"when {t} is not null then 'unknown' end")


def _fill_sql(t, d):
    return "case " + " ".join(f"when {t} = {sq.q(k)} then {sq.q(v)}" for k, v in d.items()) + " end"


@register("cls_2_3_4_entity_display", orc.tags_query(
    f"""select distinct doc_key, entity_id, label, {_overall_sql('type')} as overall_type,
          {_fill_sql('type', cl.TYPE_FILL)} as fill, {_fill_sql('type', cl.TYPE_BORDER)} as border from tags"""))
def q_cls_234(spark, sf):
    t = _tags(spark, sf)
    return t.select("doc_key", "entity_id", "label", cl.overall_tag_type(F.array("type")).alias("overall_type"),
                    cl.type_fill("type").alias("fill"), cl.type_border("type").alias("border")).distinct()


_LISTS_SQL = f"""lists as (
  select doc_key,
    {", ".join(f"coalesce(list(entity_id || chr(9) || match_text order by start, entity_id, match_text) filter (where {_overall_sql('type')} = '{kind}'), []) as {col}" for kind, col in tg.TYPE_LISTS)}
  from tags group by doc_key
),
parsed0 as (
  select doc_key, list_no, pos, typ, regexp_replace(split_part(s, chr(9), 1), '[^\\x00-\\x7F]', '', 'g') as tag,
    split_part(s, chr(9), 2) as match_text
  from ({" union all ".join(f"select doc_key, {n} as list_no, generate_subscripts({col}, 1) - 1 as pos, unnest({col}) as s, '{tg.LIST_TYPES[col]}' as typ from lists" for n, (_, col) in enumerate(tg.TYPE_LISTS))})
),
parsed as (
  select doc_key, tag, arg_min(typ, list_no * 1000000 + pos) as type, min(list_no * 1000000 + pos) as first,
    list(match_text order by list_no, pos) as match_texts
  from parsed0 group by doc_key, tag
)"""


@register("set_4_concat_tag_lists", orc.tags_query(
    "select doc_key, drug_tags || target_tags || company_tags || indication_tags as all_tags from lists",
    extra="," + _LISTS_SQL))
def q_set_4(spark, sf):
    l_ = tg.tag_lists(_tags(spark, sf))
    return l_.select("doc_key", F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>"))
                                           for _, c in tg.TYPE_LISTS]).alias("all_tags"))


@register("agg_4_parse_tag_lists", orc.tags_query(
    """select doc_key, tag, type, match_texts,
         row_number() over (partition by doc_key order by len(match_texts) desc, first) as rank from parsed""",
    extra="," + _LISTS_SQL))
def q_agg_4(spark, sf):
    p = tg.parse_tag_lists(tg.tag_lists(_tags(spark, sf)))
    return p.select("doc_key", "tag", "type", "match_texts", "rank")


def _web_span_sql(m, t):
    return f"{sq.q(hl.WEB_SPAN[0])} || {t} || {sq.q(hl.WEB_SPAN[1])} || {m} || {sq.q(hl.WEB_SPAN[2])}"


_DONE0 = "[" + ", ".join(sq.q(s) for s in hl.ALREADY_TAGGED) + "]"


def _highlighted(spark, sf, listed, tagged):
    """doc_key, tagged_text: the texts are made once, for the tags and for the highlighting; a
    document without a key has no tags."""
    texts = _tag_docs(spark, sf)
    d = dealt_by_key(texts, "doc_key")
    inp = listed(tg.tag_entities(d, fx.dictionary(spark)))
    return (d.join(inp, "doc_key", "left").select("doc_key", tagged.alias("tagged_text"))
            .union(texts.where(F.col("doc_key").isNull()).select("doc_key", F.col("document_text").alias("tagged_text"))))


@register("hlt_6_highlight_tags", orc.tags_query(
    f"""select d.doc_key, case when h.tl is null then d.document_text else list_reduce(h.tl, lambda acc, x:
          case when not list_contains(acc.done, x.m) and {orc.valid_expr('x.m', 'x.t')} then
            {{'text': case when {orc.unguarded('acc.text', 'x.m')} then replace(acc.text, x.m, {_web_span_sql('x.m', 'x.t')}) else acc.text end,
             'done': list_append(acc.done, x.m)}} else acc end,
          {{'text': d.document_text, 'done': {_DONE0}}}).text end as tagged_text
        from tdocs d left join (
          select doc_key, list({{'m': match_text, 't': t}} order by start, "end") as tl
          from (select doc_key, start, "end", match_text, arg_min(type, entity_id) as t from tags group by all)
          group by doc_key) h using (doc_key)"""))
def q_hlt_6(spark, sf):
    return _highlighted(spark, sf, tg.highlight_tags_input, hl.highlight_tags(F.col("document_text"), F.col("tags")))


def _inline_span_sql(e, t):
    fill, border = (f"(case {t} " + " ".join(f"when {sq.q(k)} then {sq.q(v)}" for k, v in m.items()) + " end)" for m in (cl.TYPE_FILL, cl.TYPE_BORDER))
    a, b, c = (sq.q(x) for x in hl.TAG_STYLE)
    return f"{sq.q(hl.TAG_SPAN[0])} || {a} || {fill} || {b} || {border} || {c} || {sq.q(hl.TAG_SPAN[1])} || {e} || {sq.q(hl.TAG_SPAN[2])}"


@register("hlt_6_highlight_tags_inline", _Q["hlt_6_highlight_tags"][1].replace(_web_span_sql('x.m', 'x.t'), _inline_span_sql('x.m', 'x.t')))
def q_hlt_6_inline(spark, sf):
    return _highlighted(spark, sf, tg.highlight_tags_input, hl.highlight_tags(F.col("document_text"), F.col("tags"), for_web=False))


@register("hlt_7_highlight_tag_lists", orc.tags_query(
    f"""select d.doc_key, case when h.tl is null then d.document_text else list_reduce(h.tl, lambda acc, x:
          case when not list_contains(acc.done, x.m) then
            {{'text': case when {orc.unguarded('acc.text', 'x.m')} then replace(acc.text, x.m, {_web_span_sql('x.m', 'x.t')}) else acc.text end,
             'done': list_append(acc.done, x.m)}} else {{'text': acc.text, 'done': list_append(acc.done, x.m)}} end,
          {{'text': d.document_text, 'done': {_DONE0}}}).text end as tagged_text
        from tdocs d left join (
          select doc_key, flatten(list(list_transform(match_texts, lambda m: {{'m': m, 't': type}}) order by first)) as tl
          from parsed group by doc_key) h using (doc_key)""", extra="," + _LISTS_SQL))
def q_hlt_7(spark, sf):
    return _highlighted(spark, sf, lambda tags: tg.highlight_list_input(tg.parse_tag_lists(tg.tag_lists(tags))),
                        hl.highlight_tags_from_list(F.col("document_text"), F.col("tag_list")))


# ---------------------------------------------------------------------------
# Pairs (JN-8/9/10, API-6)
# ---------------------------------------------------------------------------

def _sent_pairs(spark, sf):
    return pr.sentence_pairs(pr.sentence_entities(_tag_docs(spark, sf), fx.dictionary(spark)))


@register("jn_8_sentence_pairs", orc.tags_query("select doc_key, sent_no, moa, indication from spairs",
                                                extra=orc.pairs_extra()))
def q_jn_8(spark, sf):
    return _sent_pairs(spark, sf)


@register("jn_9_new_targets", orc.tags_query("select doc_key, moa, indications from new_moas",
                                             extra=orc.pairs_extra()))
def q_jn_9(spark, sf):
    return pr.new_moas(_sent_pairs(spark, sf), fx.known_pairs(spark))


@register("jn_10_new_pairs", orc.tags_query("select doc_key, moa, indication from new_pairs",
                                            extra=orc.pairs_extra()))
def q_jn_10(spark, sf):
    return pr.new_pairs(_sent_pairs(spark, sf), fx.known_pairs(spark))


# ---------------------------------------------------------------------------
# Daily statistics (API-3, AGG-6..11)
# ---------------------------------------------------------------------------

def _days(spark, sf):
    return st.day_documents(_arts(spark, sf), FROM, TO)


def _new_lists(spark, sf):
    days, d = _days(spark, sf), fx.dictionary(spark)
    texts = st.with_texts(days, _arts(spark, sf))
    return st.new_pair_lists(days, texts, st.day_tags(texts, d), d, fx.known_pairs(spark))


_DAYS = orc.day_docs_cte(FROM, TO)


@register("agg_6_daily_article_count", orc.tags_query(
    "select date, count(*) as indexed_article_count from tdocs group by all", _DAYS))
def q_agg_6(spark, sf):
    return st.article_counts(_days(spark, sf))


@register("agg_7_count_by_source", orc.tags_query(
    "select date, document_type, count(*) as n from tdocs group by all", _DAYS))
def q_agg_7(spark, sf):
    return st.by_source(_days(spark, sf))


@register("agg_8_count_by_source_detail", orc.tags_query(
    """select date, document_type, detailed_type, count(*) as n from tdocs
       group by grouping sets ((date, document_type), (date, detailed_type))""", _DAYS))
def q_agg_8(spark, sf):
    return st.by_source_both(_days(spark, sf))


@register("agg_9_10_entity_counts", orc.tags_query(
    """select t.date, g.entity_id, count(distinct g.doc_key) as tagged_entity_count, count(*) as tagged_entity_count_repeat
       from tags g join tdocs t using (doc_key) where g.valid group by all""", _DAYS))
def q_agg_9_10(spark, sf):
    return st.entity_counts(st.day_tags(st.with_texts(_days(spark, sf), _arts(spark, sf)), fx.dictionary(spark)))


@register("agg_11_new_pairs_of_day", orc.tags_query(
    "select t.date, n.moa, n.indication, t.path from new_pairs n join tdocs t using (doc_key)",
    _DAYS, extra=orc.pairs_extra()))
def q_agg_11(spark, sf):
    return _new_lists(spark, sf)[0] \
        .select("date", "moa", "indication", "path")


@register("api_3_new_targets_of_day", orc.tags_query(
    "select t.date, n.moa, n.indications, t.path from new_moas n join tdocs t using (doc_key)",
    _DAYS, extra=orc.pairs_extra()))
def q_api_3(spark, sf):
    return _new_lists(spark, sf)[1] \
        .select("date", "moa", "indications", "path")


# ---------------------------------------------------------------------------
# Fuzzy metadata filters (FUZ-1, JN-4..7, SET-1/2)
# ---------------------------------------------------------------------------

_FZ = orc.fuzzy_cands_cte()


@register("fuz_1_fuzzy_ratio", orc.alert_pipeline_sql(
    "select distinct value, pattern, score from scored", extra=_FZ))
def q_fuz_1(spark, sf):
    return al.fuzzy_pairs(al.metadata_candidates(_hits_email(spark, sf))).select("value", "pattern", "score")


def _flag_q(letter):
    def q(spark, sf):
        f = al.metadata_flags(_hits_email(spark, sf))
        return f.where(F.col(letter) == 1).select("alert_id", "doc_key")
    return q


for _letter, _name in (("j", "jn_4_journal_filter"), ("a", "jn_5_author_filter"), ("i", "jn_6_institution_filter")):
    register(_name, orc.alert_pipeline_sql(
        f"select distinct alert_id, doc_key from scored where f = '{_letter}' and score > filter_leeway", extra=_FZ)
    )(_flag_q(_letter))


def _meta_of_type(spark, sf, ftype):
    e = _hits_email(spark, sf)
    m = al.metadata_pass(e)
    sel = e.where((F.col("filter_type") == ftype) & ((F.col("journal_select") != "") | (F.col("author_select") != "")
                                                    | (F.col("institution_select") != ""))).select("alert_id").distinct()
    return m.join(sel, "alert_id").where("meta_pass").select("alert_id", "doc_key")


@register("set_1_and_filter_intersection", orc.alert_pipeline_sql(
    "select distinct alert_id, doc_key from meta where any_sel and filter_type = 'and' and meta_pass"))
def q_set_1(spark, sf):
    return _meta_of_type(spark, sf, "and")


@register("set_2_or_filter_union", orc.alert_pipeline_sql(
    "select distinct alert_id, doc_key from meta where any_sel and filter_type <> 'and' and meta_pass"))
def q_set_2(spark, sf):
    e = _hits_email(spark, sf)
    m = al.metadata_pass(e)
    sel = e.where((F.col("filter_type") != "and") & ((F.col("journal_select") != "") | (F.col("author_select") != "")
                                                    | (F.col("institution_select") != ""))).select("alert_id").distinct()
    return m.join(sel, "alert_id").where("meta_pass").select("alert_id", "doc_key")


@register("jn_7_filter_semi_join", orc.alert_pipeline_sql(
    "select alert_id, alias_seq, doc_key from meta where any_sel and meta_pass"))
def q_jn_7(spark, sf):
    e = _hits_email(spark, sf)
    ok = al.metadata_pass(e).where("meta_pass").select("alert_id", "doc_key")
    sel = e.where((F.col("journal_select") != "") | (F.col("author_select") != "") | (F.col("institution_select") != ""))
    return sel.join(ok, ["alert_id", "doc_key"], "left_semi").select("alert_id", "alias_seq", "doc_key")


# ---------------------------------------------------------------------------
# Highlight primitives over the corpus (HLT-2/3/4/5)
# ---------------------------------------------------------------------------

def _docs_q(name, sql_expr, spark_fn):
    @register(name, f"select doc_id, {sql_expr} as v from documents")
    def q(spark, sf):
        from curasift.sources.tables import read_table
        return read_table(spark, sf, "documents").select("doc_id", spark_fn(F.col("text")).alias("v"))
    return q


def _tag_span_sql(e, fill, border):
    style = f"{hl.TAG_STYLE[0]}{fill}{hl.TAG_STYLE[1]}{border}{hl.TAG_STYLE[2]}"
    return f"{sq.q(hl.TAG_SPAN[0] + style + hl.TAG_SPAN[1])} || {e} || {sq.q(hl.TAG_SPAN[2])}"


_CO = "company_OME_txt_ss"
_docs_q("hlt_3_highlight_keyword_tag",
        f"case when {orc.unguarded('text', sq.q('The'))} then replace(text, 'The', "
        f"{_tag_span_sql(sq.q('The'), cl.TYPE_FILL[_CO], cl.TYPE_BORDER[_CO])}) else text end",
        lambda t: hl.highlight_keyword_tag(t, F.lit("The"), cl.type_fill(F.lit(_CO)), cl.type_border(F.lit(_CO))))
_docs_q("hlt_4_highlight_keyword_for_web",
        f"case when {orc.unguarded('text', sq.q('The'))} then replace(text, 'The', {_web_span_sql(sq.q('The'), sq.q(_CO))}) else text end",
        lambda t: hl.highlight_keyword_for_web(t, F.lit("The"), F.lit(_CO)))
def _all_cases_sql(kw, span):
    out = "text"
    for v in (kw, kw.lower(), kw.upper(), kw.title()):
        out = f"(select case when {orc.unguarded('t', sq.q(v))} then replace(t, {sq.q(v)}, {span(sq.q(v))}) else t end from (select {out} as t))"
    return out


_docs_q("hlt_3_all_cases", _all_cases_sql("tHe", lambda v: _tag_span_sql(v, cl.TYPE_FILL[_CO], cl.TYPE_BORDER[_CO])),
        lambda t: hl.highlight_keyword_tag(t, F.lit("tHe"), cl.type_fill(F.lit(_CO)), cl.type_border(F.lit(_CO)), True))
_docs_q("hlt_4_all_cases", _all_cases_sql("tHe", lambda v: _web_span_sql(v, sq.q(_CO))),
        lambda t: hl.highlight_keyword_for_web(t, F.lit("tHe"), F.lit(_CO), True))
_docs_q("hlt_1_case_kept", f"replace({sq.mask_special('text', True)}, 'The', {orc.span(sq.q('The'))})",
        lambda t: hl.highlight_keyword(t, F.lit("The"), "no"))
_docs_q("hlt_2_highlight_subscriptions", orc.highlight_expr("text", "'the'", True),
        lambda t: hl.highlight_keyword_subscriptions(t, F.lit("the")))
_docs_q("hlt_5_highlight_keyword_list",
        "regexp_replace(lower(" + sq.mask_special("text") + "), '(on the|of the|the)', "
        + sq.q(hl.KEYWORD_SPAN[0] + hl.KEYWORD_COLOR + hl.KEYWORD_SPAN[1] + "\\1" + hl.KEYWORD_SPAN[2]) + ", 'g')",
        lambda t: hl.highlight_keyword_list(t, F.array(F.lit("the"), F.lit("on the"), F.lit("of the"))))


# ---------------------------------------------------------------------------
# Digest (AGG-13/14, FMT-3/4, TOP-4/6/7, SNK-3), owners (AGG-12), ALT-2
# ---------------------------------------------------------------------------

from curasift.plans import digest as dg  # noqa: E402

_MERGED_KEPT = """(select * from merged
  where not ((contains(doc_id, 'Cortellis') or contains(doc_id, 'cortellis')) and contains(doc_id, 'Drug_Status_Changes_alert') and contains(doc_id, 'full_email'))
    and not contains(document_type, 'clinical_trials'))"""


def _results(spark, sf):
    return cu.source_filter(al.run_alerts(_arts(spark, sf), _emailed(spark), FROM, TO))


def _digest_input(spark, sf, internal=False):
    # read for the texts to tag, for the sections' bounds and for the rows
    r = cut_lineage(_results(spark, sf))
    docs = r.select("doc_key", "document_text").distinct()
    parsed = tg.parse_tag_lists(tg.tag_lists(tg.tag_entities(docs, fx.dictionary(spark))))
    r = r.join(dg.entity_spans(parsed), "doc_key", "left")
    if internal:
        r = cu.attach_scores(r, fx.scores(spark, sf))
    return r


_RANK_SQL = "case " + " ".join(f"when document_type = {sq.q(t)} then {i}"
                              for i, t in enumerate(cl.DIGEST_TYPE_ORDER)) + " end"


@register("agg_13_digest_sections", orc.alert_pipeline_sql(
    f"""select alert_id, document_type, count(*) as n_rows,
          coalesce({_RANK_SQL}, 99) as section from {_MERGED_KEPT} group by all"""))
def q_agg_13(spark, sf):
    return dg.section_counts(_results(spark, sf))


@register("agg_14_results_per_alert", orc.alert_pipeline_sql(
    f"select alert_id, count(*) as n_results from {_MERGED_KEPT} group by all"))
def q_agg_14(spark, sf):
    return dg.result_counts(_results(spark, sf))


_SPAN_SQL = (f"'{dg.ENTITY_SPAN[0]}' || {_fill_sql('type', cl.TYPE_FILL)} || '{dg.ENTITY_SPAN[1]}' || {_fill_sql('type', cl.TYPE_BORDER)} || "
             f"'{dg.ENTITY_SPAN[2]}' || tag || ' : ' || len(match_texts) || '{dg.ENTITY_SPAN[3]}'")
_TOP5_SQL = f"""select doc_key, string_agg({_SPAN_SQL}, '' order by rank) as entity_spans from (
  select *, row_number() over (partition by doc_key order by len(match_texts) desc, first) as rank from parsed) where rank <= {dg.TOP_ENTITIES} group by doc_key"""


def _digest_sql(select: str, internal: bool = False) -> str:
    """The digest's rows in SQL: ``select`` reads them from ``digest``."""
    bold = lambda colour, text: f"""'{dg.TD_FLAG}{f";background-color: {colour}" if colour else ""}"><b>' || {text} || '</b></td>'"""

    def flag(wide: str, gap: str) -> str:
        return f"""case when contains(relevant_check, 'Relevant') then '{wide};background-color: {dg.GREEN}"><b>' || relevant_check || '</b></td>'
      when contains(relevant_check, 'NR') then {bold(dg.RED, 'relevant_check')} else '{dg.TD_FLAG}">{gap}</td>' end"""
    topic = f"""case when topic = 'relevant' then {bold(dg.GREEN, 'topic')} when topic = 'not relevant' then {bold(dg.RED, 'topic')}
      when topic in ('None', 'Not Evaluated', '') then {bold(None, "' '")} else {bold(None, 'topic')} end"""
    last = "false" if internal else "is_last"
    cell = lambda heavy, light: f"case when {last} then '{heavy}' else '{light}' end"
    cells = f"""{cell(dg.TD_KEYWORD_LAST, dg.TD_KEYWORD)} || kw || ' (' || keyword_count || ')</td>' || {cell(dg.TD_BODY_LAST, dg.TD_BODY)} || '<b>' || {sq.display_type('document_type')}
      || '</b> | <a href="' || {orc.curation_link(orc.redirect_path('doc_id'), "'ana.lee'")} || '">' || {sq.sanitize_title('title')} || '</a>'"""
    more = f"'<br><br>' || left(shorter_sentences, {dg.TEXT_CAP}) || '<br><br>' || coalesce(entity_spans, '')"
    button = lambda td, link, label: f"'{td}' || {link} || '>' || case when {link} <> '' then '{label}' else '' end || '</a></td>'"
    feedback = f" || {button(dg.TD_CORRECT, 'correct_link', 'Correct')} || {button(dg.TD_WRONG, 'wrong_link', 'Wrong')}" if internal else ""
    head = lambda wide, gap: f"{flag(wide, gap)} || {topic} || " if internal else ""
    annotate = lambda kind: f"case when sc.id is not null then '{cu.ANNOTATE_BASE}/' || {orc.owner_name('k.owner')} || '/' || sc.id || '/{kind}' else '' end"
    scored = f""", case when sc.score is null then 'No Eval' when sc.score > 0.5 then 'Relevant (' || printf('%.1f', round_even(100 * sc.score, 0)) || '%)'
      else 'NR (' || printf('%.1f', round_even(100 * sc.score, 0)) || '%)' end as relevant_check, {annotate('correct')} as correct_link, {annotate('wrong')} as wrong_link""" if internal else ""
    return orc.alert_pipeline_sql(select, extra=f""",
{fx.dictionary_sql()},
{fx.scores_sql()},
kept as materialized (select * from {_MERGED_KEPT}),
tdocs as materialized (select distinct doc_key, document_text from kept),
{orc.ents_cte()},
{orc.spans_ctes('tdocs', ['doc_key'], 'document_text', 'd')},
tags as materialized (select l.doc_key, l.start, l."end", l.match_text, l.phrase, e.entity_id, e.type, e.label, {orc.valid_expr('l.match_text', 'e.type')} as valid
  from d_long l join rel_ents e using (phrase)),{_LISTS_SQL},
spans5 as ({_TOP5_SQL}),
joined as (select k.*, entity_spans, coalesce(k.topic_class, 'Not Evaluated') as topic, coalesce({_RANK_SQL}, 99) as section,
    min({{'a': alias_seq, 'd': k.doc_key}}) over s as f, max({{'a': alias_seq, 'd': k.doc_key}}) over s = {{'a': alias_seq, 'd': k.doc_key}} as is_last{scored}
  from kept k left join spans5 using (doc_key) left join scores sc on sc.doc_key = k.doc_key window s as (partition by alert_id, document_type)),
digest as (select alert_id, doc_id, section, f.a as sec_alias, f.d as sec_doc, alias_seq, doc_key, is_last,
    '<tr>' || {head(dg.TD_FLAG, '  ')}{cells} || {more}{feedback} || '</td></tr>' as html,
    '<tr>' || {head(dg.TD_FLAG_SUMMARY, ' ')}{cells}{feedback} || '</td></tr>' as summary_html from joined)""")


_DIGEST_ROWS = "select alert_id, doc_id, section, sec_alias, sec_doc, alias_seq, doc_key, is_last, html, summary_html from digest"


@register("fmt_3_digest_rows", _digest_sql(_DIGEST_ROWS))
def q_fmt_3(spark, sf):
    return dg.digest_rows(_digest_input(spark, sf), "ana.lee")


@register("fmt_4_digest_rows_internal", _digest_sql(_DIGEST_ROWS, True))
def q_fmt_4(spark, sf):
    return dg.digest_rows(_digest_input(spark, sf, True), "ana.lee", internal=True)


@register("top_4_top5_entity_spans", orc.tags_query(_TOP5_SQL, extra="," + _LISTS_SQL))
def q_top_4(spark, sf):
    d = _tag_docs(spark, sf)
    return dg.entity_spans(tg.parse_tag_lists(tg.tag_lists(tg.tag_entities(d, fx.dictionary(spark)))))


@register("agg_12_owners_with_email", orc.alert_pipeline_sql(
    f"""select {orc.owner_name('owner')} as owner, count(distinct alert_id) as n_alerts, count(*) as n_results
        from merged group by all"""))
def q_agg_12(spark, sf):
    r = al.run_alerts(_arts(spark, sf), _emailed(spark), FROM, TO)
    return (r.groupBy(cl.owner_name(F.col("owner")).alias("owner"))
            .agg(F.count_distinct("alert_id").alias("n_alerts"), F.count(F.lit(1)).alias("n_results")))


_ALT2_SQL = orc.alert_pipeline_sql(f"""select alert_id, kpos, keyword, coalesce(n_docs, 0) as n_docs from (
    select alert_id, generate_subscripts(kws, 1) - 1 as kpos, unnest(kws) as keyword from (
      select alert_id, case when alert_type = 'standard_title' then al else [keyword] || al end as kws from (
        select *, case when coalesce(aliases, '') <> '' then list_transform(string_split(aliases, ','), lambda x: trim(x)) else [] end as al
        from alerts_in))) k
  left join (select ph as keyword, count(*) as n_docs from (
      select distinct d.doc_key, k2.ph from docs d, (select distinct unnest(kws) as ph from (
        select case when alert_type = 'standard_title' then al else [keyword] || al end as kws from (
          select *, case when coalesce(aliases, '') <> '' then list_transform(string_split(aliases, ','), lambda x: trim(x)) else [] end as al
          from alerts_in))) k2
      where len({orc.starts('d.toks', sq.phrase_norm('k2.ph'))}) > 0) group by all) c using (keyword)""", "true")


@register("alt_2_keyword_lists", _ALT2_SQL)
def q_alt_2(spark, sf):
    from curasift.operators.search import phrase_occurrences
    kl = al.keyword_lists(fx.alerts(spark)).select("alert_id", F.posexplode("keywords").alias("kpos", "keyword"))
    occ = phrase_occurrences(_docs(spark, sf).select("doc_key", "content"),
                             kl.select(F.col("keyword").alias("phrase")))
    n = occ.select("doc_key", "phrase").distinct().groupBy("phrase").agg(F.count(F.lit(1)).alias("n_docs"))
    kl = kl.withColumn("phrase", tx.phrase_norm(F.col("keyword")))
    return kl.join(n, "phrase", "left").fillna(0, ["n_docs"]).select("alert_id", "kpos", "keyword", "n_docs")


# ---------------------------------------------------------------------------
# Ranked search (QRY-6 / TOP-5)
# ---------------------------------------------------------------------------

from curasift.operators.search import bm25_top_k  # noqa: E402

_BM25_CTES = f""",
q as (select distinct alert_id * 100 + alias_seq as query_id,
        unnest(list_distinct({sq.tokens("keyphrase1 || ' ' || coalesce(keyphrase2, '')")})) as w from params),
tf as (select doc_key, w, count(*) as tf from (select doc_key, unnest(toks) as w from docs)
       where w in (select w from q) group by all),
dfq as (select w, count(*) as df from tf group by w),
dl as (select doc_key, len(toks) as dl from docs),
st as (select count(*) as n, avg(dl) as avgdl from dl),
s as (select q.query_id, tf.doc_key,
        sum(ln(1.0 + (st.n - dfq.df + 0.5) / (dfq.df + 0.5)) * tf.tf * 2.2
            / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * dl.dl / st.avgdl))) as score
      from tf join dfq using (w) join dl using (doc_key) cross join st join q using (w) group by all)"""
_BM25_SQL = orc.alert_pipeline_sql("""select query_id, doc_key, score, rank from (
  select query_id, doc_key, round(score, 6) as score,
    row_number() over (partition by query_id order by round(score, 6) desc, doc_key) as rank from s) where rank <= 20""",
                                   "true", extra=_BM25_CTES)


@register("qry_6_bm25_top_k", _BM25_SQL)
def q_qry_6(spark, sf):
    p = al.expand_alerts(fx.alerts(spark))
    qs = p.select((F.col("alert_id") * 100 + F.col("alias_seq")).alias("query_id"),
                  F.concat_ws(" ", "keyphrase1", "keyphrase2").alias("query"))
    r = bm25_top_k(_docs(spark, sf).select("doc_key", "content"), qs, 20)
    return r.select("query_id", "doc_key", "score", "rank")


@register("qry_6_postings_top_k", _BM25_SQL)
def q_qry_6_postings(spark, sf):
    """As ``qry_6_bm25_top_k``, from a postings table of all documents."""
    path = _sink_path(spark, "postings")
    po.write_postings(_docs(spark, sf).select("doc_key", "content"), path)
    p = al.expand_alerts(fx.alerts(spark))
    qs = p.select((F.col("alert_id") * 100 + F.col("alias_seq")).alias("query_id"), F.concat_ws(" ", "keyphrase1", "keyphrase2").alias("query"))
    return po.search_postings(spark, path, qs, 20).select("query_id", "doc_key", "score", "rank")


# ---------------------------------------------------------------------------
# Messages (MSG-1..3)
# ---------------------------------------------------------------------------

from curasift.operators import messages as mg  # noqa: E402

_MSG = f"with {fx.messages_sql()}\n"


@register("msg_1_messages_with_word", _MSG + "select mailbox, msg_id from messages where contains(lower(body), 'the')")
def q_msg_1(spark, sf):
    return mg.with_word(fx.messages(spark, sf), "the").select("mailbox", "msg_id")


@register("msg_2_latest_unseen", _MSG + """select mailbox, arg_max(msg_id, (ts, msg_id)) as msg_id,
    strftime(max(ts), '%Y-%m-%d %H:%M:%S') as ts, arg_max(sender, (ts, msg_id)) as sender
  from messages where not seen and ts >= timestamp '2024-01-02 00:00:00' group by mailbox""")
def q_msg_2(spark, sf):
    r = mg.latest(fx.messages(spark, sf), "unseen", "2024-01-02 00:00:00")
    return r.select("mailbox", "msg_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "sender")


@register("msg_3_body_without_trail", _MSG + """select mailbox, msg_id,
    split_part(case when length(sender) > 0 then split_part(body, sender, 1) else body end,
               chr(13) || chr(10) || chr(13) || chr(10) || '2015', 1) as body_clean from messages""")
def q_msg_3(spark, sf):
    return mg.body_without_trail(fx.messages(spark, sf))


# ---------------------------------------------------------------------------
# Sinks (SNK-1/2/3): write to the shared folder and read back
# ---------------------------------------------------------------------------

import uuid as _uuid  # noqa: E402

from curasift.session import ensure_checkpoint_dir  # noqa: E402


def _sink_path(spark, name):
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/curasift-sinks/{name}-{_uuid.uuid4().hex}"


@register("snk_1_curation_csv", orc.curation_sql())
def q_snk_1(spark, sf):
    path = _sink_path(spark, "curation")
    cu.write_curation_csv(q_api_9_curation(spark, sf), path)
    return cu.read_curation_csv(spark, path)


@register("snk_2_daily_stats_json", orc.tags_query(
    """select strftime(date, '%Y-%m-%d') as date_key, key, name, path, n::bigint as n from (
      select date, 'indexed_article_count' as key, null::varchar as name, null::varchar as path, count(*) as n from tdocs group by all
      union all select date, 'by_source', document_type, null, count(*) from tdocs group by all
      union all select date, 'by_source_detail', detailed_type, null, count(*) from tdocs group by all
      union all select date, 'tagged_entity_count', entity_id, null, count(distinct g.doc_key) from tags g join tdocs t using (doc_key) where valid group by all
      union all select date, 'tagged_entity_count_repeat', entity_id, null, count(*) from tags g join tdocs t using (doc_key) where valid group by all
      union all select date, 'new_moa_indication_pairs', moa || '|' || indication, path, 1 from new_pairs join tdocs t using (doc_key)
      union all select date, 'new_moas', moa || '|' || array_to_string(indications, ','), path, 1 from new_moas join tdocs t using (doc_key))""",
    _DAYS, extra=orc.pairs_extra()))
def q_snk_2(spark, sf):
    path = _sink_path(spark, "daily-stats")
    st.write_daily_stats(_days(spark, sf), _arts(spark, sf), fx.dictionary(spark), fx.known_pairs(spark), path)
    back = spark.read.schema("key string, name string, path string, n long, date_key string").json(path)
    return back.select("date_key", "key", "name", "path", "n")


def _pages_sql(internal: bool) -> str:
    """Lines of all alerts' pages: their number, their characters, and a sum over their MD5."""
    summary, documents = dg.table_heads(internal)
    return f"""select alert_id as alert, count(*) as n_lines, sum(length(line))::bigint as n_chars, sum(('0x' || left(md5(line), 8))::bigint)::bigint as content from (
  select alert_id, regexp_replace(unnest([html, summary_html]), '[\r\n]+', ' ', 'g') as line from digest
  union all select alert_id, unnest(['{dg.PAGE_HEAD[0]}' || count(*) || '{dg.PAGE_HEAD[1]}{summary}', '{dg.TABLE_TAIL}{dg.PAGE_MIDDLE}{documents}', '{dg.TABLE_TAIL}{dg.PAGE_TAIL}'])
    from digest group by alert_id) group by alert_id"""


def _pages(spark, rows, internal):
    path = _sink_path(spark, "digest")
    dg.write_digest(rows, path, internal)
    back = spark.read.text(path)
    return back.groupBy(F.col("alert").cast("int").alias("alert")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars"),
        F.sum(F.conv(F.left(F.md5("value"), F.lit(8)), 16, 10).cast("long")).alias("content"))


@register("snk_3_digest_text", _digest_sql(_pages_sql(False)))
def q_snk_3(spark, sf):
    return _pages(spark, q_fmt_3(spark, sf), False)


@register("snk_3_digest_text_internal", _digest_sql(_pages_sql(True), True))
def q_snk_3_internal(spark, sf):
    return _pages(spark, q_fmt_4(spark, sf), True)


_HALF = ("2024-01-15", "2024-01-16")  # the last day of the first period, the first of the second


@register("src_6_new_pairs_of_two_periods", orc.tags_query(
    f"""select 1 as version, doc_key, moa, indication from p1 where moa in (select moa from known_pairs) and (moa, indication) not in (select moa, indication from known_pairs)
    union all select 2, doc_key, moa, indication from p2 where moa in (select moa from known2) and (moa, indication) not in (select moa, indication from known2)""",
    _DAYS, extra=orc.pairs_extra() + f""",
    p1 as (select distinct doc_key, moa, indication from spairs join tdocs using (doc_key) where date <= date '{_HALF[0]}'),
    p2 as (select distinct doc_key, moa, indication from spairs join tdocs using (doc_key) where date >= date '{_HALF[1]}'),
    known2 as (select moa, indication from known_pairs union select moa, indication from p1)"""))
def q_src_6(spark, sf):
    """Two periods in turn over the stored dictionary and the stored known pairs: the first one's
    pairs are known in the second."""
    path = _sink_path(spark, "known")
    ks.write_dictionary(fx.dictionary(spark), f"{path}/dictionary")
    ks.write_known_pairs(fx.known_pairs(spark), f"{path}/pairs")
    found = [st.learn_pairs(spark, _arts(spark, sf), ks.read_dictionary(spark, f"{path}/dictionary"), f"{path}/pairs", v, a, b).withColumn("version", F.lit(v))
             for v, (a, b) in enumerate(((FROM, _HALF[0]), (_HALF[1], TO)), 1)]
    return found[0].unionByName(found[1]).select("version", "doc_key", "moa", "indication")


# ---------------------------------------------------------------------------
# Streaming variant (extension): watermarked daily source counts
# ---------------------------------------------------------------------------

from curasift.streaming import documents_stream as ds  # noqa: E402


@register("stream_daily_source_counts", orc.articles_query(
    f"""select strftime(file_modified_date, '%Y-%m-%d') as day, {_T} as document_type, count(*) as n
        from articles where doc_id <> '' and content is not null and exclusion_flag is null group by all"""))
def q_stream_counts(spark, sf):
    out = ds.run_to_table(ds.daily_source_counts(spark, sf), "daily-source-counts", mode="complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "document_type",
                      F.col("n").cast("long").alias("n"))


# ---------------------------------------------------------------------------
# PRJ-2 publication date, SRC-7 single-document view
# ---------------------------------------------------------------------------

@register("prj_2_publication_date", orc.articles_query(
    "select doc_id, pub_date from articles where doc_id like '/PMC/%' or doc_id like '/PubMed_abstracts/%'"))
def q_prj_2(spark, sf):
    a = _arts(spark, sf)
    return a.where(F.col("doc_id").startswith("/PMC/") | F.col("doc_id").startswith("/PubMed_abstracts/")) \
            .select("doc_id", "pub_date")


_PR_DOCS = f"""tdocs as (
  select doc_key, doc_id, {sq.document_text('content')} as document_text from articles
  where path0 = 'Press releases' and doc_id <> '' and content is not null and exclusion_flag is null
)"""


# the HLT-7 oracle body, keyed by path instead of document key
_HLT7_BODY = _Q["hlt_7_highlight_tag_lists"][1].split("\nselect d.doc_key,", 1)[1]


@register("src_7_document_view", orc.tags_query("select d.doc_id," + _HLT7_BODY, _PR_DOCS, extra="," + _LISTS_SQL))
def q_src_7(spark, sf):
    a = _arts(spark, sf)
    paths = a.where(F.col("path0") == "Press releases").select("doc_id")
    return lookups.document_view(a, fx.dictionary(spark), paths)


# ---------------------------------------------------------------------------
# API-1: one search with each tag mode
# ---------------------------------------------------------------------------

from curasift.operators import tagmodes as tm  # noqa: E402

_API1 = "alert_id = 4"  # two phrases in three sources


def _fold_sql(text: str, valid: bool, span) -> str:
    guard = f"not list_contains(acc.done, x.m) and {orc.valid_expr('x.m', 'x.t')}" if valid else "not list_contains(acc.done, x.m)"
    return (f"case when tl is null then {text} else list_reduce(tl, lambda acc, x: case when {guard} then "
            f"{{'text': case when {orc.unguarded('acc.text', 'x.m')} then replace(acc.text, x.m, {span('x.m', 'x.t')}) else acc.text end, "
            f"'done': list_append(acc.done, x.m)}} else acc end, {{'text': {text}, 'done': {_DONE0}}}).text end")


def _api1_sql(mode: str) -> str:
    lists = mode in ("web", "email")
    span = _inline_span_sql if mode == "inline" else _web_span_sql
    shown = mode in ("web", "web_new_pairs", "inline")
    text = _fold_sql("kt", not lists, span) if shown else "kt"
    short = _fold_sql("shorter_sentences", True, span) if mode in ("web_new_pairs", "inline") else "shorter_sentences"
    tl = ("""select doc_key, flatten(list(list_transform(match_texts, lambda m: {'m': m, 't': type}) order by first)) as tl from parsed group by doc_key""" if lists else
          """select doc_key, list({'m': match_text, 't': t} order by start, "end") as tl
             from (select doc_key, start, "end", match_text, arg_min(type, entity_id) as t from tags group by all) group by doc_key""")
    order = ("select doc_key, list(tag order by len(match_texts) desc, first) as eo from parsed group by doc_key" if lists else
             """select doc_key, list(entity_id order by c desc, f, entity_id) as eo from (
                  select doc_key, entity_id, count(*) filter (valid) as c, min(start) as f from tags group by all) group by doc_key""")
    pairs = mode in ("web_new_pairs", "pairs")
    extra = f""",
{fx.dictionary_sql()},
{fx.known_pairs_sql()},
res as (select doc_key, alias_seq, document_type, keyword_count, document_text, shorter_sentences, sub,
  case when sub then {orc.highlight_expr('document_text', 'kw', True)} else {orc.highlight_expr('document_text', 'kw', False)} end as kt from e2),
tdocs as materialized (select distinct doc_key, document_text from res),
{orc.ents_cte()},
{orc.spans_ctes('tdocs', ['doc_key'], 'document_text', 'd')},
tags as materialized (select l.doc_key, l.start, l."end", l.match_text, l.phrase, e.entity_id, e.type, e.label, {orc.valid_expr('l.match_text', 'e.type')} as valid
  from d_long l join rel_ents e using (phrase)){orc.pairs_extra()},{_LISTS_SQL},
tls as ({tl}), eos as ({order}),
nps as (select doc_key, string_agg(x, ';' order by x) as np from (select distinct doc_key, moa || '|' || indication as x from new_pairs) group by doc_key),
nms as (select doc_key, string_agg(x, ';' order by x) as nm from (select distinct doc_key, moa || '|' || array_to_string(indications, ',') as x from new_moas) group by doc_key)"""
    return orc.alert_pipeline_sql(f"""select doc_key, alias_seq, keyword_count, {text} as tagged_document_text, {short} as shorter_sentences,
  coalesce(array_to_string(eo, ';'), '') as entities_ordered, {"coalesce(np, '')" if pairs else "''"} as new_pairs, {"coalesce(nm, '')" if pairs else "''"} as new_moas
from res left join tls using (doc_key) left join eos using (doc_key) left join nps using (doc_key) left join nms using (doc_key)""", _API1, extra=extra)


def _api1_q(mode: str):
    def q(spark, sf):
        from curasift.session import cut_lineage
        arts = _arts(spark, sf)
        hits = cut_lineage(al.alert_hits(arts, lookups.alert_by_id(fx.alerts(spark), 4), FROM, TO))
        found = cut_lineage(al.enrich(hits, arts, F.col("keyword")))
        out = tm.tag_results(found, fx.dictionary(spark), fx.known_pairs(spark), mode)
        return out.select("doc_key", "alias_seq", "keyword_count", "tagged_document_text", "shorter_sentences",
                          *[F.array_join(c, ";").alias(c) for c in ("entities_ordered", "new_pairs", "new_moas")])
    return q


for _mode in tm.MODES[:-1]:
    register(f"api_1_mode_{_mode}", _api1_sql(_mode))(_api1_q(_mode))


# ---------------------------------------------------------------------------
# QRY-4: lone phrases with slop, over all tokens of the phrase
# ---------------------------------------------------------------------------

_SLOP = 2
_SLOPPY = orc.sloppy_sql(_SLOP)


@register("qry_4_sloppy_phrase", _SLOPPY)
def q_qry_4(spark, sf):
    """Every multi-word alias with slop 2, and the phrases of the fixture (two to four tokens,
    some repeated) with their own."""
    p = al.expand_alerts(fx.alerts(spark)).where(F.contains(tx.phrase_norm(F.col("keyword")), F.lit(" ")))
    p = p.select(*KEYS, F.col("keyword").alias("keyphrase1"), F.lit(_SLOP).alias("keyphrase_distance")).unionByName(
        fx.sloppy_phrases(spark).select(F.col("phrase_id").alias("alert_id"), F.lit(0).alias("alias_seq"), F.col("phrase").alias("keyphrase1"), F.col("slop").alias("keyphrase_distance")))
    return search_hits(_docs(spark, sf).select("doc_key", "content"), p.withColumn("keyphrase2", F.lit(None).cast("string")), KEYS)
