"""Source classification, tag-type rules, labels and projections as Column
expressions (CLS-*, PRJ-*, FLT-7, SCR-1).  Rule tables are data; the
``when`` chains are generated from them at plan time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# CLS-1: ordered substring rules on the document id -> (type, detailed type);
# the first rule that matches wins; no match -> newswire/newswire.
SOURCE_RULES = [
    ("CT.gov", "clinical_trials", "CT.gov"),
    ("EMEA", "clinical_trials", "EMEA"),
    ("EU_CT", "clinical_trials", "EU_CT"),
    ("Adis", "Adis Insight", "Adis Insight"),
    ("evaluate", "Evaluate News", "Evaluate News"),
    ("PMDA", "clinical_trials", "PMDA"),
    ("FDA_Medical_reviews", "FDA_Medical_reviews", "FDA_Medical_reviews"),
    ("fda_guidance", "fda_guidance", "fda_guidance"),
    ("fiercepharma", "newswire", "fiercepharma"),
    ("fiercebiotech", "newswire", "fiercebiotech"),
    ("politico", "newswire", "politico_morning_eHealth"),
    ("alpha", "newswire", "seeking_alpha_healthcare"),
    ("cortellis", "Cortellis", "Cortellis"),
    ("Cortellis", "Cortellis", "Cortellis"),
    ("IPD", "IPD", "IPD"),
    ("ipd", "IPD", "IPD"),
    ("GBD", "GBD_email", "GBD_email"),
    ("PMC", "pubmed_article", "pubmed_article"),
    ("Google_Search", "google_news", "google_news"),
    ("google_news", "google_news", "google_news"),
    ("PRNW", "pr_newswire", "pr_newswire"),
    ("streetaccount", "streetaccount", "streetaccount"),
    ("PubMed_abstracts", "pubmed_abstract", "pubmed_abstract"),
    ("evercore", "evercore", "evercore"),
    ("Twitter", "twitter", "twitter"),
    ("SEC_Filings", "SEC_filing", "SEC_filing"),
    ("Press releases", "press_release", None),  # detail from the basename
]
# Press-release wires that keep their own name (others become CompanyPR_<name>).
PRESS_WIRES = ["FirstWordPharma", "PinkPharmaintelligenceInforma", "EndPoints", "MassDevice"]
# Document types handled by the subscription variants (SNP-2, HLT-2).
SUBSCRIPTION_TYPES = ["Adis Insight", "Cortellis", "GBD_email", "Evaluate News"]
PUBMED_TYPES = ["pubmed_abstract", "pubmed_article"]
# FLT-7: aliases never valid as a tag.
TRASH_ALIASES = ['3% -4 .1', '14 .1', '2 .1', '2% 1', 'T', 'R', 'BL', 'multi', 'plan', 'ED', 'full',
                 'mark', 'DM', 'impact', 'Impact', 'name', 'large', 'sync', 'apps', 'rest', 'DC',
                 'BD', 'was', 'an', 'An']
# FLT-8: dictionaries whose entities are kept.
RELEVANT_DICTIONARIES = ['company_OME_txt_ss', 'drug_OME_txt_ss', 'target_ChemBL_txt_ss',
                         'target_OME_txt_ss', 'target_MeSH_txt_ss', 'indication_OME2_txt_ss',
                         'indication_MeSH_orpha_txt_ss', 'indication_MeSH_suppl_txt_ss']
# CLS-4: entity type -> fill colour and border colour (r, g, b).
TYPE_FILL = {
    'company_OME_txt_ss': '237, 249, 213', 'drug_OME_txt_ss': '217, 244, 255',
    'indication_MeSH_txt_ss': '213, 241, 238', 'indication_OME_txt_ss': '213, 241, 238',
    'indication_OME2_txt_ss': '213, 241, 238', 'indication_MeSH_orpha_txt_ss': '213, 241, 238',
    'indication_MeSH_suppl_txt_ss': '213, 241, 238', 'indication_Treato_txt_ss': '213, 241, 238',
    'target_ChemBL_txt_ss': '249, 204, 230', 'target_OME_txt_ss': '249, 204, 230',
    'target_MeSH_txt_ss': '249, 204, 230',
}
TYPE_BORDER = {
    'company_OME_txt_ss': '166, 226, 45', 'drug_OME_txt_ss': '67, 198, 252',
    'indication_MeSH_txt_ss': '47, 187, 171', 'indication_OME_txt_ss': '47, 187, 171',
    'indication_OME2_txt_ss': '47, 187, 171', 'indication_MeSH_orpha_txt_ss': '47, 187, 171',
    'indication_MeSH_suppl_txt_ss': '47, 187, 171', 'indication_Treato_txt_ss': '47, 187, 171',
    'target_ChemBL_txt_ss': '224, 0, 132', 'target_OME_txt_ss': '224, 0, 132',
    'target_MeSH_txt_ss': '224, 0, 132',
}
# TOP-7: digest section order; other types follow in order of appearance.
DIGEST_TYPE_ORDER = ['press_release', 'clinical_trials', 'pubmed_abstract', 'pubmed_article',
                     'GBD_email', 'Cortellis', 'IPD', 'fda_guidance', 'FDA_Medical_reviews',
                     'newswire', 'pr_newswire', 'streetaccount', 'google_news', 'SEC_filing']
# Label for documents without a topic class (PRJ-3) and without a score (SCR-1).
NOT_EVALUATED = "Not Evaluated"
NO_EVAL = "No Eval"
RELEVANT_CUTOFF = 0.50
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def document_type(doc_id) -> Column:
    """CLS-1: struct<document_type, detailed_type> from the ordered rules."""
    d = _col(doc_id)
    name = F.substring_index(F.substring_index(d, "/", -1), "_", 1)
    pr_detail = F.when(name.isin(PRESS_WIRES), name).otherwise(F.concat(F.lit("CompanyPR_"), name))
    out = F.struct(F.lit("newswire").alias("document_type"), F.lit("newswire").alias("detailed_type"))
    for needle, typ, det in reversed(SOURCE_RULES):
        detail = F.lit(det) if det is not None else pr_detail
        out = F.when(F.contains(d, F.lit(needle)),
                     F.struct(F.lit(typ).alias("document_type"), detail.alias("detailed_type"))
                     ).otherwise(out)
    return out


def overall_tag_type(types) -> Column:
    """CLS-2: the last type of the list decides."""
    t = F.try_element_at(_col(types), F.lit(-1))
    return (F.when(t.contains("indication"), "indication").when(t.contains("target"), "target")
            .when(t.contains("company"), "company").when(t.contains("drug"), "drug")
            .when(t.isNotNull(), "unknown"))


def entity_label(preferred, skos_pref, label, skos_alt, entity_id) -> Column:
    """CLS-3: first present label, else the id (empty strings count as absent)."""
    def present(c):
        c = _col(c)
        return F.when(c != "", c)
    return F.coalesce(present(preferred), present(skos_pref), present(label), present(skos_alt),
                      _col(entity_id))


def _map_lit(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def type_fill(t) -> Column:
    """CLS-4: fill colour of an entity type."""
    return _map_lit(TYPE_FILL)[_col(t)]


def type_border(t) -> Column:
    return _map_lit(TYPE_BORDER)[_col(t)]


def tag_is_valid(match_text, tag_type) -> Column:
    """FLT-7: stop-listed aliases are invalid, longer than 3 chars valid, else
    only target/indication tags written in capitals (Python ``isupper``: at
    least one cased letter and no lower-case one)."""
    m, t = _col(match_text), _col(tag_type)
    is_upper = m.rlike("[A-Z]") & ~m.rlike("[a-z]")
    return (F.when(m.isin(TRASH_ALIASES), F.lit(False))
            .when(F.length(m) > 3, F.lit(True))
            .otherwise((t.contains("target") | t.contains("indication")) & is_upper))


def display_title(doc_type, title_txt, journal_title, article_title, article_title_alt,
                  journal_name) -> Column:
    """PRJ-1: PubMed titles from journal + article fields, else the raw title."""
    jt, at, alt, jn = map(_col, (journal_title, article_title, article_title_alt, journal_name))
    pub = (F.when(jt.isNotNull() & at.isNotNull(), F.concat(jt, F.lit(" | "), at))
           .when(at.isNotNull(), at)
           .when(jt.isNotNull() & alt.isNotNull(), F.concat(jt, F.lit(" | "), alt))
           .when(jn.isNotNull() & alt.isNotNull(), F.concat(jn, F.lit(" | "), alt))
           .when(alt.isNotNull(), alt)
           .otherwise(_col(title_txt)))
    return F.when(_col(doc_type).isin(PUBMED_TYPES), pub).otherwise(_col(title_txt))


def _parts_date(y, m, d) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", _col(y), _col(m), _col(d)), F.lit("yyyy-M-d")).cast("date")


def _iso_date(ts) -> Column:
    return F.try_to_timestamp(F.substring_index(_col(ts), "T", 1), F.lit("yyyy-M-d")).cast("date")


def publication_date(completed_y, completed_m, completed_d, issue_pub_ts, article_y, article_m,
                     article_d, pub_ts, history_pub, history_pub_ts, today) -> Column:
    """PRJ-2: the first *present* date field decides (date completed parts,
    issue date, article date parts, publication date, PubMed history list,
    PubMed history date); an unparsable value gives NULL (the document is
    then kept by FLT-4); none present gives ``today`` (a parameter)."""
    hist = F.get(_col(history_pub), 0)
    return (F.when(_col(completed_y).isNotNull(), _parts_date(completed_y, completed_m, completed_d))
            .when(_col(issue_pub_ts).isNotNull(), _iso_date(issue_pub_ts))
            .when(_col(article_y).isNotNull(), _parts_date(article_y, article_m, article_d))
            .when(_col(pub_ts).isNotNull(), _iso_date(pub_ts))
            .when(hist.isNotNull(), _iso_date(hist))
            .when(_col(history_pub_ts).isNotNull(), _iso_date(history_pub_ts))
            .otherwise(F.lit(today).cast("date")))


def topic_class(c) -> Column:
    """PRJ-3."""
    return F.coalesce(_col(c), F.lit(NOT_EVALUATED))


def redirect_path(doc_id, base: str) -> Column:
    """PRJ-4: id with '/' -> '!!!', '!' trimmed at both ends, after a base URL."""
    p = F.regexp_replace(F.replace(_col(doc_id), F.lit("/"), F.lit("!!!")), "^!+|!+$", "")
    return F.concat(F.lit(base), p)


def curation_link(path, user, shown: str = "alert_document", curated: str = "curate_alert_document_v2") -> Column:
    """PRJ-5: spaces escaped, user substituted, the path word of the document view replaced by
    that of the curation view."""
    p = F.replace(_col(path), F.lit(" "), F.lit("%20"))
    p = F.replace(p, F.lit(shown), F.lit(curated))
    return F.replace(p, F.lit("<user_name>"), _col(user))


def short_title(title) -> Column:
    """PRJ-6: shorten subscription titles by their '_' parts; out-of-range
    parts keep the original title (Q-17); GBD by ``contains`` (Q-16)."""
    t = _col(title)
    parts = F.split(t, "_", -1)

    def pick(idx):
        pieces = [F.get(parts, i) for i in idx]
        ok = reduce(lambda a, b: a & b, [p.isNotNull() for p in pieces])
        return F.when(ok, F.concat_ws("_", *pieces)).otherwise(t)
    return (F.when(F.array_contains(parts, "AdisInsight"), pick([1, 3, 4]))
            .when(F.array_contains(parts, "Evaluate"), pick([0, 2, 6]))
            .when(F.contains(t, F.lit("GBD_email_v2")), pick([1, 2, 5, 8]))
            .when(F.array_contains(parts, "ipd"), pick([0]))
            .otherwise(t))


def score_label(score) -> Column:
    """SCR-1: 'Relevant (p%)' above the cut-off, 'NR (p%)' otherwise, 'No Eval'
    when missing; p = 100*score rounded half-even, one decimal shown."""
    s = _col(score).cast("double")
    pct = F.format_string("%.1f", F.bround(s * 100.0, 0))
    return (F.when(s.isNull(), F.lit(NO_EVAL))
            .when(s > RELEVANT_CUTOFF, F.concat(F.lit("Relevant ("), pct, F.lit("%)")))
            .otherwise(F.concat(F.lit("NR ("), pct, F.lit("%)"))))


def owner_name(c) -> Column:
    """FMT-5: owner without a 'DOMAIN\\' prefix."""
    return F.regexp_replace(_col(c), "^.*\\\\", "")
