"""DuckDB oracle SQL for the registered queries.  Each text re-derives the
query's result from the shared tables with plain SQL (list lambdas, window
functions), independently of the Spark plan."""

from __future__ import annotations

from curasift.checks import sqlfrag as sq
from curasift.functions import classify as cl
from curasift.functions import highlight as hl
from curasift.sources import fixtures as fx

RANGE = ("2024-01-01", "2024-01-30")


def doc_type_case(e: str) -> str:
    name = f"split_part(regexp_extract({e}, '[^/]*$'), '_', 1)"
    pr = f"(case when {name} in ({', '.join(sq.q(w) for w in cl.PRESS_WIRES)}) then {name} else 'CompanyPR_' || {name} end)"
    t = "case " + " ".join(f"when contains({e}, {sq.q(n)}) then {sq.q(ty)}" for n, ty, _ in cl.SOURCE_RULES) + " else 'newswire' end"
    d = "case " + " ".join(f"when contains({e}, {sq.q(n)}) then {sq.q(det) if det else pr}"
                           for n, _, det in cl.SOURCE_RULES) + " else 'newswire' end"
    return t, d


def display_title(t: str) -> str:
    return f"""(case when {t} in ('pubmed_abstract', 'pubmed_article') then (case
      when journal_title is not null and article_title is not null then journal_title || ' | ' || article_title
      when article_title is not null then article_title
      when journal_title is not null and article_title_alt is not null then journal_title || ' | ' || article_title_alt
      when journal_name is not null and article_title_alt is not null then journal_name || ' | ' || article_title_alt
      when article_title_alt is not null then article_title_alt
      else title_txt end) else title_txt end)"""


def ordered_distinct(e: str) -> str:
    return f"list_filter({e}, lambda x, i: x <> '' and list_position({e}, x) = i)"


def params_cte() -> str:
    terms = ("(case when alert_type = 'standard' then (case when length(coalesce(aliases, '')) >= 2 "
             "then [keyword] || string_split(aliases, ', ') else [keyword] end) "
             "when alert_type = 'standard_title' then string_split(coalesce(aliases, ''), ', ') "
             "when contains(alert_type, 'cooccurence') then string_split(coalesce(aliases, ''), ', ') "
             "else [] end)")
    return f"""params as (
  select alert_id, alias_seq - 1 as alias_seq,
    case when cooc then keyword else term end as keyphrase1,
    case when cooc then term end as keyphrase2,
    case when cooc and len(string_split(alert_type, '_')) > 1 then try_cast(string_split(alert_type, '_')[2] as integer) end as keyphrase_distance,
    term as keyword, owner, source_select, alert_title, filter_type,
    coalesce(journal_select, '') as journal_select, coalesce(author_select, '') as author_select,
    coalesce(institution_select, '') as institution_select, coalesce(filter_leeway, 70) as filter_leeway
  from (select *, contains(alert_type, 'cooccurence') as cooc, unnest(terms) as term, generate_subscripts(terms, 1) as alias_seq
        from (select *, {ordered_distinct(terms)} as terms from alerts_in))
)"""


def starts(toks: str, phrase: str) -> str:
    pt = f"string_split({phrase}, ' ')"
    return (f"(case when {phrase} is null or {phrase} = '' then [] else "
            f"list_filter(range(1, len({toks}) + 1), lambda i: {toks}[i:i + len({pt}) - 1] = {pt}) end)")


def source_match() -> str:
    return ("(coalesce(source_select, 'all') = 'all' or len(list_filter(string_split(coalesce(source_select, 'all'), ', '), "
            "lambda s: case when s = 'Ct.gov' then starts_with(path_basename, 'CT.gov-added_or_modified_studies') "
            "else path0 = s end)) > 0)")


def hits_ctes(from_date: str, to_date: str) -> str:
    t, d = doc_type_case("doc_id")
    return f"""docs as materialized (
  select *, {sq.tokens('content')} as toks from articles
  where file_modified_date between date '{from_date}' and date '{to_date}'
    and doc_id <> '' and content is not null and exclusion_flag is null
),
pp as (
  select *, {sq.phrase_norm('keyphrase1')} as p1,
    {sq.phrase_norm('keyphrase2')} as p2 from params
),
ph as materialized (select distinct p as phrase, len(string_split(p, ' ')) as n
  from (select p1 as p from pp union all select p2 from pp) where p <> ''),
grams as (
  select doc_key, n, i, array_to_string(toks[i:i + n - 1], ' ') as g
  from (select doc_key, toks, n, unnest(range(1, len(toks) - n + 2)) as i from docs, (select distinct n from ph))
),
occ as materialized (select doc_key, phrase, list(i order by i) as s from grams join ph on g = phrase and grams.n = ph.n group by all),
cand as (
  select pp.*, docs.* exclude (toks), o1.s as s1, coalesce(o2.s, []) as s2, len(string_split(p1, ' ')) as len1
  from pp join occ o1 on o1.phrase = p1 join docs using (doc_key) left join occ o2 on o2.phrase = p2 and o2.doc_key = docs.doc_key
),
found0 as (
  select * from cand
  where case when p2 is null or p2 = '' then len(s1) > 0
             when keyphrase_distance is null then len(s1) > 0 and len(s2) > 0
             else len(list_filter(s1, lambda a: len(list_filter(s2, lambda b: abs(b - a - len1) <= keyphrase_distance)) > 0)) > 0 end
),
found as (
  select * from found0 where {source_match()}
),
typed as (
  select *, {t} as document_type, {d} as detailed_type from found
),
titled as (
  select *, {display_title('document_type')} as title from typed
  where document_type not in ('pubmed_abstract', 'pubmed_article') or pub_date is null or pub_date >= date '{from_date}'
),
hits as (
  select * exclude (rn) from (
    select *, case when title <> title_txt or title_txt is null then 1
      else row_number() over (partition by alert_id, alias_seq, title_txt order by doc_key) end as rn
    from titled) where rn = 1
)"""


def snippet_expr(doctext: str, kw: str, sub: bool) -> str:
    colon = not sub
    sents = sq.text_to_sentences(sq.mask_special(doctext, colon))
    kwl = f"lower({sq.mask_special(kw, colon)})"
    piece = "(case when i = 0 then '' when i = (case when k = 1 then 0 else idx[k - 1] end) + 1 then ' ' else ' ... ' end) || "
    piece += sq.mark_sections("ss[i + 1]") if sub else "ss[i + 1]"
    return (f"(select list_reduce(list_transform(idx, lambda i, k: {piece}), "
            f"lambda acc, p: case when length(acc) < 500 then acc || p else acc end, '') "
            f"from (select ss, list_filter(range(0, len(ss)), lambda i: contains(lower(ss[i + 1]), kl)) as idx "
            f"from (select {sents} as ss, {kwl} as kl)))")


def py_title(e: str) -> str:
    return (f"array_to_string(list_transform(list_filter(string_split({e}, ''), lambda c: c <> ''), lambda ch, i: "
            f"case when i = 1 or not regexp_matches(list_filter(string_split({e}, ''), lambda c: c <> '')[i - 1], '^[A-Za-z]$') "
            f"then upper(ch) else lower(ch) end), '')")


def span(e: str) -> str:
    return f"'{hl.KEYWORD_SPAN[0]}{hl.KEYWORD_COLOR}{hl.KEYWORD_SPAN[1]}' || {e} || '{hl.KEYWORD_SPAN[2]}'"


def unguarded(t: str, n: str) -> str:
    p = f"strpos({t}, {n})"
    return f"(length({n}) > 0 and {p} > 0 and ({p} = 1 or substr({t}, {p} - 1, 1) <> '>'))"


def highlight_expr(text: str, kw: str, sub: bool) -> str:
    colon = not sub
    t, k = sq.mask_special(text, colon), sq.mask_special(kw, colon)
    body = (f"(select case when {unguarded('lower(t)', 'lower(k)')} then replace(lower(t), lower(k), {span('lower(k)')}) "
            f"when {unguarded('t', 'kt')} then replace(t, kt, {span('kt')}) else t end "
            f"from (select t, k, {py_title('k')} as kt from (select {t} as t, {k} as k)))")
    if sub:
        return sq.keep_sections(sq.mark_sections(body))
    return body


def ratio(a: str, b: str) -> str:
    lcs = (f"list_reduce(list_filter(string_split({a}, ''), lambda c: c <> ''), lambda prev, ch: list_reduce(range(1, length({b}) + 1), "
           f"lambda cur, j: list_append(cur, case when ch = substr({b}, j::int, 1) then prev[j] + 1 "
           f"else greatest(prev[j + 1], cur[j]) end), [0]), list_transform(range(0, length({b}) + 1), lambda x: 0))"
           f"[length({b}) + 1]")
    return (f"(case when {a} is null or {b} is null then null when length({a}) = 0 or length({b}) = 0 then 0 "
            f"else cast(round_even(200.0 * {lcs} / (length({a}) + length({b})), 0) as integer) end)")


def enriched_ctes() -> str:
    sub = f"document_type in ({', '.join(sq.q(s) for s in cl.SUBSCRIPTION_TYPES)})"
    cnt1 = sq.count_whole_word(f"lower({sq.mask_special('document_text', True)})", f"lower({sq.mask_special('kw', True)})")
    cnt2 = sq.count_whole_word(f"lower({sq.mask_special('document_text', False)})", f"lower({sq.mask_special('kw', False)})")
    jl = "list_filter(string_split(journal_select, ', '), lambda x: x <> '')"
    al = "list_filter(string_split(author_select, ', '), lambda x: x <> '')"
    il = "list_filter(string_split(institution_select, ', '), lambda x: x <> '')"
    jv = "coalesce(journal_title, journal_name)"
    return f"""e0 as (
  select * exclude (keyword), trim(keyword) as kw, {sq.document_text('content')} as document_text,
    {sub} as sub from hits
),
e1 as (
  select *, case when kw = '' then 0 when sub then {cnt2} else {cnt1} end as keyword_count,
    case when kw = '' then '' when sub then {snippet_expr('document_text', 'kw', True)}
         else {snippet_expr('document_text', 'kw', False)} end as snippet
  from e0
),
e2 as (
  select *, case when kw = '' then document_text when sub then {highlight_expr('snippet', 'kw', True)}
         else {highlight_expr('snippet', 'kw', False)} end as shorter_sentences
  from e1
),
meta as (
  select *, case when not any_sel then true
    when filter_type = 'and' then (j or journal_select = '') and (a or author_select = '') and (i or institution_select = '')
    else (j or a or i) end and (pub or not any_sel) as meta_pass
  from (select *, document_type in ('pubmed_abstract', 'pubmed_article') as pub,
      (journal_select <> '' or author_select <> '' or institution_select <> '') as any_sel,
      document_type in ('pubmed_abstract', 'pubmed_article') and len(list_filter({jl}, lambda p: {ratio('p', jv)} > filter_leeway)) > 0 as j,
      document_type in ('pubmed_abstract', 'pubmed_article') and len(list_filter({al}, lambda p: len(list_filter(authors, lambda v: {ratio('p', 'v')} > filter_leeway)) > 0)) > 0 as a,
      document_type in ('pubmed_abstract', 'pubmed_article') and len(list_filter({il}, lambda p: len(list_filter(institutions, lambda v: {ratio('v', 'p')} > filter_leeway)) > 0)) > 0 as i
    from e2)
),
merged as (
  select m.*, k.keyword_list_label from (
    select * exclude (rn) from (
      select *, row_number() over (partition by alert_id, doc_id order by alias_seq) as rn from meta where meta_pass)
    where rn = 1) m
  join (select alert_id, doc_id, string_agg(kw || ' (' || cast(keyword_count as varchar) || ')', ', '
          order by keyword_count desc, alias_seq) as keyword_list_label
        from meta group by alert_id, doc_id) k using (alert_id, doc_id)
)"""


def short_title(t: str) -> str:
    parts = f"string_split({t}, '_')"

    def pick(idx):
        ps = [f"{parts}[{i + 1}]" for i in idx]
        ok = " and ".join(f"{p} is not null" for p in ps)
        joined = " || '_' || ".join(ps)
        return f"(case when {ok} then {joined} else {t} end)"
    return (f"(case when list_contains({parts}, 'AdisInsight') then {pick([1, 3, 4])} "
            f"when list_contains({parts}, 'Evaluate') then {pick([0, 2, 6])} "
            f"when contains({t}, 'GBD_email_v2') then {pick([1, 2, 5, 8])} "
            f"when list_contains({parts}, 'ipd') then {pick([0])} else {t} end)")


def redirect_path(e: str) -> str:
    return f"'{fx_redirect_base()}' || regexp_replace(replace({e}, '/', '!!!'), '^!+|!+$', '', 'g')"


def fx_redirect_base() -> str:
    from curasift.operators.alerts import REDIRECT_BASE
    return REDIRECT_BASE


def owner_name(e: str) -> str:
    return f"regexp_replace({e}, '^.*\\\\', '')"


def curation_link(path: str, user: str) -> str:
    return (f"replace(replace(replace({path}, ' ', '%20'), 'alert_document', 'curate_alert_document_v2'), "
            f"'<user_name>', {user})")


def alert_pipeline_sql(select: str, alerts_filter: str = "email = 'yes'", rng=RANGE, extra: str = "") -> str:
    return f"""with {fx.articles_sql()},
{fx.alerts_sql()},
alerts_in as (select * from alerts where {alerts_filter}),
{params_cte()},
{hits_ctes(*rng)},
{enriched_ctes()}{extra}
{select}"""


def sloppy_sql(slop: int) -> str:
    """QRY-4 by enumeration: places are chosen token by token, at different positions, while the
    largest shift less the smallest stays within the slop."""
    return f"""with recursive {fx.articles_sql()},
{fx.alerts_sql()},
{fx.sloppy_sql()},
alerts_in as (select * from alerts),
{params_cte()},
ph as (select alert_id, alias_seq, string_split({sq.phrase_norm('keyword')}, ' ') as t, {slop} as slop from params where contains({sq.phrase_norm('keyword')}, ' ')
  union all select phrase_id, 0, string_split({sq.phrase_norm('phrase')}, ' '), slop from sloppy),
tok as materialized (select doc_key, unnest(t) as w, unnest(range(1, len(t) + 1)) as p from (select doc_key, {sq.tokens('content')} as t from articles
  where file_modified_date between date '{RANGE[0]}' and date '{RANGE[1]}' and doc_id <> '' and content is not null and exclusion_flag is null)),
chosen as (
  select alert_id, alias_seq, t, slop, doc_key, 1 as k, p as lo, p as hi, [p] as used from ph join tok on tok.w = ph.t[1]
  union
  select alert_id, alias_seq, t, slop, c.doc_key, k + 1, least(lo, p - k), greatest(hi, p - k), list_append(used, p)
  from chosen c join tok on c.doc_key = tok.doc_key and tok.w = t[k + 1]
  where k < len(t) and not list_contains(used, p) and greatest(hi, p - k) - least(lo, p - k) <= slop)
select distinct alert_id, alias_seq, doc_key from chosen where k = len(t)"""


def curation_sql(alerts_filter: str = "email = 'yes'") -> str:
    sel = f"""select alert_title as query_context, keyword_list_label as keyword_counts,
  concat_ws(' | ', document_type, {short_title('title')}, shorter_sentences) as type_title_sentence,
  'NA' as curation,
  {curation_link(redirect_path('doc_id'), owner_name('owner'))} as document_link
from merged
where not ((contains(doc_id, 'Cortellis') or contains(doc_id, 'cortellis')) and contains(doc_id, 'Drug_Status_Changes_alert') and contains(doc_id, 'full_email'))
  and not contains(document_type, 'clinical_trials')"""
    return alert_pipeline_sql(sel, alerts_filter)


def articles_query(select: str) -> str:
    return f"""with {fx.articles_sql()}
{select}"""


# ---------------------------------------------------------------------------
# Tagging, pairs and daily statistics
# ---------------------------------------------------------------------------

def valid_expr(m: str, t: str) -> str:
    trash = ", ".join(sq.q(x) for x in cl.TRASH_ALIASES)
    return (f"(case when {m} in ({trash}) then false when length({m}) > 3 then true "
            f"else (contains({t}, 'target') or contains({t}, 'indication')) and regexp_matches({m}, '[A-Z]') "
            f"and not regexp_matches({m}, '[a-z]') end)")


def spans_ctes(src: str, keys: list[str], text: str, prefix: str, kw_join: str | None = None) -> str:
    """CTEs {prefix}_spans (all occurrences) and {prefix}_long (longest) of
    dictionary phrases over ``text`` of ``src``."""
    k = ", ".join(keys)
    kj = f" join {kw_join} using (doc_key, phrase)" if kw_join else ""
    return f"""{prefix}_ph as materialized (select distinct phrase, len(string_split(phrase, ' ')) as n from ents where phrase <> ''),
{prefix}_grams as (
  select {k}, n, s1, array_to_string(raw[s1:s1 + n - 1], ' ') as match_text
  from (select {k}, raw, n, unnest(range(1, len(raw) - n + 2)) as s1
        from (select {k}, {sq.raw_tokens(text)} as raw from {src}), (select distinct n from {prefix}_ph))
),
{prefix}_spans as materialized (
  select {k}, phrase, s1 - 1 as start, s1 - 1 + g.n as "end", match_text
  from {prefix}_grams g join {prefix}_ph p on lower(match_text) = phrase and g.n = p.n
),
{prefix}_long as (
  select * exclude (reach) from (
    select *, max("end") over (partition by {k} order by start, "end" desc rows between unbounded preceding and 1 preceding) as reach
    from {prefix}_spans{kj}) where reach is null or "end" > reach
)"""


def tag_docs_cte() -> str:
    return f"""tdocs as (
  select doc_key, {sq.document_text('content')} as document_text from articles
  where doc_id <> '' and content is not null and exclusion_flag is null
)"""


def ents_cte() -> str:
    rel = ", ".join(sq.q(x) for x in cl.RELEVANT_DICTIONARIES)
    label = ("coalesce(nullif(preferred_label, ''), nullif(skos_pref, ''), nullif(label, ''), "
             "nullif(skos_alt, ''), entity_id)")
    return f"""ents as (
  select {sq.phrase_norm('alias')} as phrase, entity_id, type, {label} as label from dictionary
),
rel_ents as (select * from ents where type in ({rel}))"""


def tags_query(select: str, docs_cte: str | None = None, extra: str = "") -> str:
    return f"""with {fx.articles_sql()},
{fx.dictionary_sql()},
{fx.known_pairs_sql()},
{docs_cte or tag_docs_cte()},
{ents_cte()},
{spans_ctes('tdocs', ['doc_key'], 'document_text', 'd')},
tags as (
  select l.doc_key, l.start, l."end", l.match_text, l.phrase, e.entity_id, e.type, e.label,
    {valid_expr('l.match_text', 'e.type')} as valid
  from d_long l join rel_ents e using (phrase)
){extra}
{select}"""


def pairs_extra() -> str:
    return f""",
kw as (
  select doc_key, phrase, min(entity_id) as entity_id from tags
  where valid and (starts_with(type, 'target') or starts_with(type, 'indication')) group by all
),
kwt as (select kw.*, e.type from kw join rel_ents e using (phrase, entity_id)),
sents as (
  select doc_key, generate_subscripts(s, 1) - 1 as sent_no, unnest(s) as sentence
  from (select doc_key, {sq.text_to_sentences('document_text')} as s from tdocs)
),
{spans_ctes('sents', ['doc_key', 'sent_no'], 'sentence', 's', 'kwt')},
sent_ents as (
  select doc_key, sent_no, start, entity_id,
    case when contains(type, 'target') then 'target' when contains(type, 'indication') then 'indication' end as kind
  from s_long
),
spairs as (
  select distinct t.doc_key, t.sent_no, t.entity_id as moa, i.entity_id as indication
  from sent_ents t join sent_ents i on t.doc_key = i.doc_key and t.sent_no = i.sent_no
  where t.kind = 'target' and i.kind = 'indication'
),
new_pairs as (
  select distinct doc_key, moa, indication from spairs
  where moa in (select moa from known_pairs) and (moa, indication) not in (select moa, indication from known_pairs)
),
new_moas as (
  select distinct doc_key, moa, indications from (
    select doc_key, sent_no, moa, list_sort(list_distinct(list(indication))) as indications from spairs
    where moa not in (select moa from known_pairs) group by all)
)"""


def day_docs_cte(from_date: str, to_date: str) -> str:
    t, d = doc_type_case("doc_id")
    return f"""dd0 as (
  select *, {t} as document_type, {d} as detailed_type from articles
  where file_modified_date between date '{from_date}' and date '{to_date}'
    and doc_id <> '' and content is not null and exclusion_flag is null
),
dd1 as (
  select *, {display_title('document_type')} as title from dd0
  where document_type not in ('pubmed_abstract', 'pubmed_article') or pub_date is null or pub_date >= file_modified_date
),
tdocs as (
  select doc_key, doc_id, file_modified_date as date, document_type, detailed_type, title,
    replace({redirect_path('doc_id')}, 'alert_document', 'curate_alert_document') as path,
    {sq.document_text('content')} as document_text
  from (select *, case when title <> title_txt or title_txt is null then 1
          else row_number() over (partition by file_modified_date, title_txt order by doc_key) end as rn from dd1)
  where rn = 1
)"""


def fuzzy_cands_cte() -> str:
    """Oracle twin of ``metadata_candidates`` over the ``e2`` CTE."""
    pub = "document_type in ('pubmed_abstract', 'pubmed_article')"
    sl = lambda c: f"list_filter(string_split({c}, ', '), lambda x: x <> '')"
    return f""",
cands as (
  select distinct alert_id, doc_key, filter_leeway, 'j' as f, p as pattern, coalesce(journal_title, journal_name) as value
    from e2, unnest({sl('journal_select')}) as t(p) where {pub}
  union all
  select distinct alert_id, doc_key, filter_leeway, 'a' as f, p as pattern, v as value
    from e2, unnest({sl('author_select')}) as t(p), unnest(authors) as u(v) where {pub}
  union all
  select distinct alert_id, doc_key, filter_leeway, 'i' as f, p as pattern, v as value
    from e2, unnest({sl('institution_select')}) as t(p), unnest(institutions) as u(v) where {pub}
),
scored as (select *, {ratio('pattern', 'value')} as score from cands where value is not null)"""
