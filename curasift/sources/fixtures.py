"""Views over the shared test tables that stand in for the reference's inputs
(see FIXTURES.md): ``articles`` (index documents), ``scores`` (relevance),
``messages`` (mailbox), plus the small configuration tables ``alerts``,
``dictionary`` and ``known_pairs``.

Every builder has a DuckDB twin (``*_sql``) that yields the same rows; the
oracle texts in ``curasift.checks.oracles`` are built from them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from curasift.checks.sqlfrag import values_cte
from curasift.functions import classify as cl
from curasift.sources.tables import read_table

# ---------------------------------------------------------------------------
# Fixed values (FIXTURES.md section 2): source code -> index path prefix.
# Sources not listed are newswire documents under '/newswire/<source>_'.
# ---------------------------------------------------------------------------
SOURCE_PREFIXES = [
    ("src0", "/CT.gov/CT.gov-added_or_modified_studies_"),
    ("src1", "/EMEA/e_"),
    ("src2", "/Adis/AdisInsight_x_"),
    ("src3", "/evaluate/Evaluate_"),
    ("src4", "/PMC/pmc_"),
    ("src5", "/PubMed_abstracts/p_"),
    ("src6", "/cortellis/Drug_Status_Changes_alert_full_email_"),
    ("src7", "/Press releases/Acme_"),
    ("src8", "/Press releases/EndPoints_"),
    ("src9", "/GBD/g_"),
]
BASE_DATE = "2024-01-01"
N_DAYS = 30
TODAY = "2024-03-01"   # the "today" of publication dates with no date field

# ---------------------------------------------------------------------------
# Configuration tables (inline in both engines).  Keywords are real corpus
# tokens so that every alert finds documents at every scale factor.
# ---------------------------------------------------------------------------
ALERT_COLUMNS = ["alert_id", "keyword", "aliases", "owner", "email", "alert_type", "source_select",
                 "alert_title", "filter_type", "journal_select", "author_select",
                 "institution_select", "filter_leeway"]
ALERT_ROWS = [
    (1, "the", "on the, of the", "CORP\\ana.lee", "yes", "standard", "all",
     "NEWS_standard_the", "or", "", "", "", 70),
    (2, "that", "with the, by the", "CORP\\ana.lee", "yes", "cooccurence", "all",
     "NEWS_cooccurence_that", "or", "", "", "", 70),
    (3, "and", "of the, to the", "CORP\\ben.ng", "yes", "cooccurence_3", "all",
     "NEWS_cooccurence_and", "or", "", "", "", 70),
    (4, "from", "this is, it is, this is", "CORP\\ben.ng", "yes", "standard_title",
     "PubMed_abstracts, Press releases, Ct.gov", "NEWS_title_from", "or", "", "", "", 70),
    (5, "with", "was, are", "CORP\\ana.lee", "yes", "standard", "PMC, PubMed_abstracts",
     "NEWS_metadata_or", "or", "smal ring, blue bolt", "Customer#00000012", "", 90),
    (6, "for", "as the", "CORP\\ana.lee", "yes", "standard", "all", "NEWS_metadata_and", "and",
     "small gizmo, smal bolt", "", "Supplier#00000001", 80),
    (7, "is", "", "CORP\\cy.ho", "no", "standard", "all", "NEWS_no_email", "or", "", "", "", 70),
    (8, "on the", "x", "CORP\\cy.ho", "yes", "standard", "Ct.gov", "NEWS_ctgov_only", "or",
     "", "", "", 70),
    (9, "the", "it, that", "ana.lee", "yes", "cooccurence_0", "EMEA, PMC", "NEWS_adjacent",
     "or", "", "", "", 70),
]
ALERT_SCHEMA = T.StructType([
    T.StructField("alert_id", T.IntegerType()), T.StructField("keyword", T.StringType()),
    T.StructField("aliases", T.StringType()), T.StructField("owner", T.StringType()),
    T.StructField("email", T.StringType()), T.StructField("alert_type", T.StringType()),
    T.StructField("source_select", T.StringType()), T.StructField("alert_title", T.StringType()),
    T.StructField("filter_type", T.StringType()), T.StructField("journal_select", T.StringType()),
    T.StructField("author_select", T.StringType()),
    T.StructField("institution_select", T.StringType()),
    T.StructField("filter_leeway", T.IntegerType()),
])

#: Lone phrases with a slop of their own (QRY-4).
SLOPPY_COLUMNS = ["phrase_id", "phrase", "slop"]
SLOPPY_ROWS = [
    (101, "of the", 1),
    (102, "The road, the", 4),
    (103, "with the and", 3),
    (104, "the of the", 2),
    (105, "the the", 0),
    (106, "and the and the", 5),
    (107, "that is on the", 6),
    (108, "on", 3),
]
SLOPPY_SCHEMA = T.StructType([T.StructField("phrase_id", T.IntegerType()), T.StructField("phrase", T.StringType()), T.StructField("slop", T.IntegerType())])

DICTIONARY_COLUMNS = ["alias", "entity_id", "type", "preferred_label", "skos_pref", "label", "skos_alt"]
DICTIONARY_ROWS = [
    ("the", "company:The Co", "company_OME_txt_ss", None, None, "The Co", None),
    ("on the", "indication:onthe", "indication_OME2_txt_ss", "On-the disease", None, None, None),
    ("of the", "indication:ofthe", "indication_MeSH_orpha_txt_ss", None, "Of-the syndrome", None, None),
    ("by the", "indication:bythe", "indication_MeSH_suppl_txt_ss", None, None, None, "By-the"),
    ("in the", "indication:inthe", "indication_OME2_txt_ss", None, None, None, None),
    ("that", "target:THAT1", "target_OME_txt_ss", "THAT1", None, None, None),
    ("it is", "target:ITIS", "target_ChemBL_txt_ss", None, None, "ITIS kinase", None),
    ("with", "drug:withumab", "drug_OME_txt_ss", "withumab", None, None, None),
    ("this", "company:This Inc", "company_OME_txt_ss", None, None, None, None),
    ("this", "drug:thisinib", "drug_OME_txt_ss", None, None, None, None),
    ("and", "target:AND", "target_MeSH_txt_ss", None, None, None, None),
    ("is", "target:IS", "target_OME_txt_ss", None, None, None, None),
    ("was", "drug:was", "drug_OME_txt_ss", None, None, None, None),
    ("from", "person:from", "person_txt_ss", None, None, None, None),
    ("the road", "company:Road Ltd", "company_OME_txt_ss", None, None, None, None),
    ("to the", "target:TOTHE", "target_MeSH_txt_ss", None, None, None, None),
]
DICTIONARY_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in DICTIONARY_COLUMNS])

KNOWN_PAIR_COLUMNS = ["moa", "indication"]
KNOWN_PAIR_ROWS = [
    ("target:THAT1", "indication:onthe"),
    ("target:THAT1", "indication:inthe"),
    ("target:ITIS", "indication:ofthe"),
]
KNOWN_PAIR_SCHEMA = T.StructType([T.StructField("moa", T.StringType()),
                                  T.StructField("indication", T.StringType())])


def _local(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """Configuration rows as a local relation, whose size the optimizer knows."""
    columns = {f.name: [r[i] for r in rows] for i, f in enumerate(schema.fields)}
    return spark.createDataFrame(pa.Table.from_pydict(columns, schema=to_arrow_schema(schema)), schema)


def alerts(spark: SparkSession) -> DataFrame:
    return _local(spark, ALERT_ROWS, ALERT_SCHEMA)


def sloppy_phrases(spark: SparkSession) -> DataFrame:
    return _local(spark, SLOPPY_ROWS, SLOPPY_SCHEMA)


def dictionary(spark: SparkSession) -> DataFrame:
    return _local(spark, DICTIONARY_ROWS, DICTIONARY_SCHEMA)


def known_pairs(spark: SparkSession) -> DataFrame:
    return _local(spark, KNOWN_PAIR_ROWS, KNOWN_PAIR_SCHEMA)


def _source_map(spark: SparkSession) -> DataFrame:
    return _local(spark, SOURCE_PREFIXES, T.StructType([T.StructField("source", T.StringType()), T.StructField("prefix", T.StringType())]))


def articles(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Index documents derived from ``documents`` (FIXTURES.md 2): path-like
    ``doc_id``, title, modified/publication dates, journal (``part``),
    authors (``customer``), institutions (``supplier``), exclusion flag and
    topic class (``labels``).

    The documents' keys spread over the whole dimensions, which grow with the
    data; the joins are left to the optimizer, never forced.  ``documents`` may be a streaming DataFrame (the
    dimension joins are then stream-static joins)."""
    d = (documents if documents is not None else read_table(spark, sf_dir, "documents")) \
        .select("doc_id", "text", "source")
    # Dimension sides are grouped on their key (the keys are unique, so this
    # changes no row).  A left join to a side that is distinct on the join
    # key cannot add rows, so the optimizer removes it from every branch that
    # uses none of its columns (search and text branches read only the key
    # and the text).
    def dim(name, key, val, new_key, new_val):
        t = read_table(spark, sf_dir, name)
        return t.groupBy(F.col(key).alias(new_key)).agg(F.min(val).alias(new_val))

    def spread(over, name, key):  # over all keys of the dimension, 0 .. max
        return over % read_table(spark, sf_dir, name).agg((F.max(key) + 1).alias("n")).scalar()
    part = dim("part", "p_partkey", "p_name", "j_key", "journal_title")
    a1 = dim("customer", "c_custkey", "c_name", "a1_key", "author1")
    a2 = dim("customer", "c_custkey", "c_name", "a2_key", "author2")
    sup = dim("supplier", "s_suppkey", "s_name", "i_key", "institution")
    lab = dim("labels", "doc_id", "toxic", "l_doc", "toxic")
    src = F.broadcast(_source_map(spark))  # 10 fixed rows

    day = (F.col("doc_id") % N_DAYS).cast("int")
    base = F.to_date(F.lit(BASE_DATE))
    x = (d.join(src, "source", "left")
         .withColumn("j_key", spread(F.col("doc_id"), "part", "p_partkey"))
         .withColumn("a1_key", spread(F.col("doc_id"), "customer", "c_custkey"))
         .withColumn("a2_key", spread(F.col("doc_id") * 7 + 3, "customer", "c_custkey"))
         .withColumn("i_key", spread(F.col("doc_id"), "supplier", "s_suppkey"))
         .join(part, "j_key", "left").join(a1, "a1_key", "left").join(a2, "a2_key", "left")
         .join(sup, "i_key", "left")
         .join(lab, F.col("doc_id") == F.col("l_doc"), "left"))
    doc_path = F.concat(F.coalesce(F.col("prefix"), F.concat(F.lit("/newswire/"), F.col("source"), F.lit("_"))),
                        F.col("doc_id").cast("string"))
    fmd = F.date_add(base, day)
    # raw publication date fields: date-completed parts for doc_id % 3 = 0
    # (month written 'Jan' -- unparsable -- when doc_id % 9 = 0), an ISO
    # publication timestamp for doc_id % 3 = 1, nothing otherwise
    pub = F.date_sub(fmd, (F.col("doc_id") % 7).cast("int"))
    m3 = F.col("doc_id") % 3
    x = (x.withColumn("date_completed_y", F.when(m3 == 0, F.year(pub).cast("string")))
          .withColumn("date_completed_m", F.when(m3 == 0, F.when(F.col("doc_id") % 9 == 0, F.lit("Jan"))
                                                  .otherwise(F.month(pub).cast("string"))))
          .withColumn("date_completed_d", F.when(m3 == 0, F.dayofmonth(pub).cast("string")))
          .withColumn("pub_ts", F.when(m3 == 1, F.concat(F.date_format(pub, "yyyy-MM-dd"), F.lit("T00:00:00Z")))))
    none = F.lit(None).cast("string")
    return x.select(
        doc_path.alias("doc_id"),
        F.col("doc_id").alias("doc_key"),
        F.col("text").alias("content"),
        F.substring("text", 1, 60).alias("title_txt"),
        fmd.alias("file_modified_date"),
        cl.publication_date("date_completed_y", "date_completed_m", "date_completed_d", none, none, none, none,
                            "pub_ts", F.lit(None).cast("array<string>"), none, TODAY).alias("pub_date"),
        F.col("journal_title"),
        F.lit(None).cast("string").alias("journal_name"),
        F.lit(None).cast("string").alias("article_title"),
        F.lit(None).cast("string").alias("article_title_alt"),
        F.array_compact(F.array("author1", "author2")).alias("authors"),
        F.array_compact(F.array("institution")).alias("institutions"),
        F.when(F.col("doc_id") % 17 == 0, F.lit("yes")).alias("exclusion_flag"),
        F.when(F.col("toxic") == 1, F.lit("not relevant"))
         .when(F.col("toxic") == 0, F.lit("relevant")).alias("topic_class"),
    ).withColumn("path0", F.element_at(F.split("doc_id", "/"), 2)) \
     .withColumn("path_basename", F.substring_index("doc_id", "/", -1))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance scores (FIXTURES.md 2), one row per labelled document, in the
    reference's score-table shape (id, score, doc key, processed time)."""
    lab = read_table(spark, sf_dir, "labels")
    return lab.select(
        (F.col("doc_id") + 1000000).alias("id"),
        F.col("doc_id").alias("doc_key"),
        (F.col("quality").cast("double") * 0.6 + (F.col("doc_id") % 10).cast("double") * 0.04
         - F.col("toxic").cast("double") * 0.2).alias("score"),
        F.to_timestamp(F.lit("2024-02-01 00:00:00")).alias("processed_dt"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mailbox stand-in from ``conversations`` (conv -> mailbox, turn -> msg id,
    role -> sender, text -> body); every third message is unseen and message
    times step by one hour from the base date."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("box"), F.col("conv_id").cast("string")).alias("mailbox"),
        F.col("turn").alias("msg_id"),
        (F.to_timestamp(F.lit(BASE_DATE)) + F.make_dt_interval(F.lit(0), (F.col("conv_id") % 48 + F.col("turn")).cast("int"))).alias("ts"),
        ((F.col("conv_id") + F.col("turn")) % 3 != 0).alias("seen"),
        F.col("role").alias("sender"),
        F.col("text").alias("body"),
    )


# ---------------------------------------------------------------------------
# DuckDB twins (CTE bodies; the shared tables are pre-registered views).
# ---------------------------------------------------------------------------

def articles_sql() -> str:
    src = values_cte("src", ["source", "prefix"], SOURCE_PREFIXES)
    return f"""{src},
articles as (
  select concat(coalesce(s.prefix, concat('/newswire/', d.source, '_')), cast(d.doc_id as varchar)) as doc_id,
    d.doc_id as doc_key, d.text as content, substring(d.text, 1, 60) as title_txt,
    cast(date '{BASE_DATE}' + cast(d.doc_id % {N_DAYS} as integer) as date) as file_modified_date,
    case when d.doc_id % 3 = 0 then try_strptime(
           cast(year(pd) as varchar) || '-' || (case when d.doc_id % 9 = 0 then 'Jan' else cast(month(pd) as varchar) end)
           || '-' || cast(day(pd) as varchar), '%Y-%m-%d')::date
         when d.doc_id % 3 = 1 then try_strptime(strftime(pd, '%Y-%m-%d'), '%Y-%m-%d')::date
         else date '{TODAY}' end as pub_date,
    p.p_name as journal_title, cast(null as varchar) as journal_name,
    cast(null as varchar) as article_title, cast(null as varchar) as article_title_alt,
    list_filter([c1.c_name, c2.c_name], lambda v: v is not null) as authors,
    list_filter([su.s_name], lambda v: v is not null) as institutions,
    case when d.doc_id % 17 = 0 then 'yes' end as exclusion_flag,
    case when l.toxic = 1 then 'not relevant' when l.toxic = 0 then 'relevant' end as topic_class,
    split_part(concat(coalesce(s.prefix, concat('/newswire/', d.source, '_')), cast(d.doc_id as varchar)), '/', 2) as path0,
    regexp_extract(concat(coalesce(s.prefix, concat('/newswire/', d.source, '_')), cast(d.doc_id as varchar)), '[^/]*$') as path_basename
  from (select *, cast(date '{BASE_DATE}' + cast(doc_id % {N_DAYS} as integer) - cast(doc_id % 7 as integer) as date) as pd
        from documents) d
  left join src s on d.source = s.source
  left join part p on p.p_partkey = d.doc_id % (select max(p_partkey) + 1 from part)
  left join customer c1 on c1.c_custkey = d.doc_id % (select max(c_custkey) + 1 from customer)
  left join customer c2 on c2.c_custkey = (d.doc_id * 7 + 3) % (select max(c_custkey) + 1 from customer)
  left join supplier su on su.s_suppkey = d.doc_id % (select max(s_suppkey) + 1 from supplier)
  left join labels l on l.doc_id = d.doc_id
)"""


def scores_sql() -> str:
    return """scores as (
  select doc_id + 1000000 as id, doc_id as doc_key,
    cast(quality as double) * 0.6 + cast(doc_id % 10 as double) * 0.04 - cast(toxic as double) * 0.2 as score,
    timestamp '2024-02-01 00:00:00' as processed_dt
  from labels
)"""


def alerts_sql() -> str:
    return values_cte("alerts", ALERT_COLUMNS, ALERT_ROWS)


def sloppy_sql() -> str:
    return values_cte("sloppy", SLOPPY_COLUMNS, SLOPPY_ROWS)


def dictionary_sql() -> str:
    return values_cte("dictionary", DICTIONARY_COLUMNS, DICTIONARY_ROWS)


def known_pairs_sql() -> str:
    return values_cte("known_pairs", KNOWN_PAIR_COLUMNS, KNOWN_PAIR_ROWS)


def messages_sql() -> str:
    return f"""messages as (
  select 'box' || cast(conv_id as varchar) as mailbox, turn as msg_id,
    timestamp '{BASE_DATE} 00:00:00' + to_hours(cast(conv_id % 48 + turn as integer)) as ts,
    (conv_id + turn) % 3 <> 0 as seen, role as sender, text as body
  from conversations
)"""
