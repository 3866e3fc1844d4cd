"""HTML digest of alert results (AGG-13/14, FMT-3/4, TOP-4/6/7, SNK-3).

A digest has a summary table (keyword, type and title of each result) and a document
table (with snippet and entities as well); the internal ones add relevance, topic class and
feedback links.  It stays a DataFrame of rows -- one HTML row for either table per result, with
its section rank and order -- never one string per alert held in a single
row: an alert can match a large share of the corpus.  The sink writes each
alert's two tables in order (range-partitioned by alert and order, sorted within), framed by
the page's and the tables' heads and tails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curasift.functions import classify as cl
from curasift.functions import text as tx
from curasift.session import cut_lineage

# ---------------------------------------------------------------------------
# Cell styles of the digest table.
# ---------------------------------------------------------------------------
TD_KEYWORD = '<td style="border-bottom:1px solid #000000;max-width:150px">'
TD_BODY = '<td style="border-bottom:1px solid #000000;max-width:300px">'
TD_KEYWORD_LAST = '<td style="border-bottom:2px solid #000000;max-width:150px">'
TD_BODY_LAST = '<td style="border-bottom:2px solid #000000;max-width:300px">'
ENTITY_SPAN = ('<span style="background-color: rgb(', '); padding:0px; margin:0px; line-height: 1; '
               'border-radius: 0.25em; border: 1px solid; border-color: rgb(', ');">', '</span>  ')
GREEN, RED = "rgb(51, 204, 51)", "rgb(230, 46, 0)"
TD_FLAG = '<td style="border-right:1px solid #000000;border-bottom:1px solid #000000;max-width:300px'
TD_FLAG_SUMMARY = '<td style="border-right:1px solid #000000;border-bottom:1px solid #000000;max-width:150px'
TD_CORRECT = ('<td style="border-bottom:1px solid #000000; border-right: 1px solid #000000; border-left: 1px solid #000000; '
              'max-width:150px"><a href =')
TD_WRONG = '<td style="border-bottom:1px solid #000000;max-width:150px"><a href ='
TABLE = '<table style="border:2px solid #000000">'
TABLE_SUMMARY = '<table style="border:2px solid #000000;border-collapse:collapse;">'
HEAD_KEYWORD = ('<thead><th style="border-bottom:2px solid #000000;max-width:150px">Keyword (count)</th>'
                '<th style="border-bottom:2px solid #000000;max-width:400px">')
HEAD_DOCUMENTS, HEAD_SUMMARY = "Document Type | Title | Tagged Sentence</th></thead>", "Document Type | Title </th></thead>"
HEAD_RELEVANT = '<thead><th style="border-bottom:2px solid #000000;max-width:400px">Relevant? - IM</th></thead>'
HEAD_RELEVANT_SUMMARY = '<thead><th style="border-bottom:2px solid #000000;max-width:500px">Relevant? - IM</th></thead>'
HEAD_TOPIC = '<thead><th style="border-bottom:2px solid #000000;max-width:400px">LDA Class - YMR</th></thead>'
HEAD_FEEDBACK = ('<thead><th style="border-bottom:2px solid #000000;max-width:150px">Correct?</th>'
                 '<th style="border-bottom:2px solid #000000;max-width:400px">Wrong? </th></thead>')
TABLE_TAIL = "</tbody></table>"
PAGE_HEAD = ("<html><head></head><body><h4>Summary (", " results)</h4>")
PAGE_MIDDLE, PAGE_TAIL = "<br><br><h4>Documents</h4>", "</body></html>"
TEXT_CAP = 1000   # TOP-6
TOP_ENTITIES = 5  # TOP-4
# ---------------------------------------------------------------------------


def type_rank(t: Column) -> Column:
    """TOP-7: listed types first, in list order; others after (99)."""
    m = F.create_map(*[x for i, ty in enumerate(cl.DIGEST_TYPE_ORDER) for x in (F.lit(ty), F.lit(i))])
    return F.coalesce(m[t], F.lit(99))


def entity_spans(parsed: DataFrame, key: str = "doc_key") -> DataFrame:
    """TOP-4: the first five entities of a document (by number of match
    texts, then first appearance) as coloured 'entity : n' spans."""
    top = parsed.where(F.col("rank") <= TOP_ENTITIES)
    span = F.concat(F.lit(ENTITY_SPAN[0]), cl.type_fill("type"), F.lit(ENTITY_SPAN[1]), cl.type_border("type"),
                    F.lit(ENTITY_SPAN[2]), F.col("tag"), F.lit(" : "), F.size("match_texts").cast("string"),
                    F.lit(ENTITY_SPAN[3]))
    return (top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", span.alias("s")))).alias("_s"))
            .select(key, F.array_join(F.transform("_s", lambda x: x["s"]), "").alias("entity_spans")))


def table_heads(internal: bool = False) -> tuple[str, str]:
    """The heads of the summary table and of the document table."""
    if not internal:
        return TABLE_SUMMARY + HEAD_KEYWORD + HEAD_SUMMARY + "<tbody>", TABLE + HEAD_KEYWORD + HEAD_DOCUMENTS + "<tbody>"
    return (TABLE_SUMMARY + HEAD_RELEVANT_SUMMARY + HEAD_TOPIC + HEAD_KEYWORD + HEAD_SUMMARY + HEAD_FEEDBACK + "<tbody>",
            TABLE + HEAD_RELEVANT + HEAD_TOPIC + HEAD_KEYWORD + HEAD_DOCUMENTS + HEAD_FEEDBACK + "<tbody>")


def _marked(td: str, colour: str | None, text: Column) -> Column:
    return F.concat(F.lit(td + (f";background-color: {colour}" if colour else "") + '"><b>'), text, F.lit("</b></td>"))


def _flag(summary: bool) -> Column:
    """The relevance cell."""
    rel = F.col("relevant_check")
    return (F.when(rel.contains("Relevant"), _marked(TD_FLAG_SUMMARY if summary else TD_FLAG, GREEN, rel))
            .when(rel.contains("NR"), _marked(TD_FLAG, RED, rel)).otherwise(F.lit(TD_FLAG + ('"> </td>' if summary else '">  </td>'))))


def _topic() -> Column:
    """The topic class cell."""
    lda = F.col("topic_class")
    return (F.when(lda == "relevant", _marked(TD_FLAG, GREEN, lda)).when(lda == "not relevant", _marked(TD_FLAG, RED, lda))
            .when(lda.isin("None", "Not Evaluated", ""), _marked(TD_FLAG, None, F.lit(" "))).otherwise(_marked(TD_FLAG, None, lda)))


def _button(td: str, link: str, label: str) -> Column:
    return F.concat(F.lit(td), F.col(link), F.lit(">"), F.when(F.col(link) != "", F.lit(label)).otherwise(F.lit("")), F.lit("</a></td>"))


def digest_rows(results: DataFrame, user: str, internal: bool = False) -> DataFrame:
    """FMT-3 (internal=False) / FMT-4 (True): the HTML rows of each alert result.

    ``results``: alert_id, doc_id, alias_seq, doc_key, keyword, keyword_count,
    document_type, title, path, shorter_sentences, entity_spans (nullable);
    internal also relevant_check, topic_class, correct_link, wrong_link.
    Output: alert_id, doc_id, the ordering key (section = TOP-7 rank,
    sec_alias / sec_doc = first appearance of the section, alias_seq,
    doc_key), is_last (last row of its section: heavier rule), html (row of the document
    table), summary_html (row of the summary table).

    No window over an alert: section bounds come from a small per
    (alert, type) aggregate (size-checked broadcast), and the order is a sort
    key the sink range-partitions on, so a hot alert spreads over tasks."""
    from curasift.operators.joins import broadcast_if_small
    bounds = (results.groupBy("alert_id", "document_type")
              .agg(F.min(F.struct("alias_seq", "doc_key")).alias("_first"),
                   F.max(F.struct("alias_seq", "doc_key")).alias("_last")))
    r = (results.withColumn("section", type_rank(F.col("document_type")))
         .join(broadcast_if_small(bounds), ["alert_id", "document_type"])
         .withColumn("is_last", F.struct("alias_seq", "doc_key") == F.col("_last"))
         .withColumn("sec_alias", F.col("_first.alias_seq")).withColumn("sec_doc", F.col("_first.doc_key")))
    link = cl.curation_link(F.col("path"), F.lit(user))
    title = tx.sanitize_title(F.col("title"))
    heavier = F.col("is_last") & F.lit(not internal)  # the internal table has one rule for all rows
    td_kw = F.when(heavier, F.lit(TD_KEYWORD_LAST)).otherwise(F.lit(TD_KEYWORD))
    td_body = F.when(heavier, F.lit(TD_BODY_LAST)).otherwise(F.lit(TD_BODY))
    cells = [td_kw, F.col("keyword"), F.lit(" ("), F.col("keyword_count").cast("string"), F.lit(")</td>"),
             td_body, F.lit("<b>"), tx.display_type(F.col("document_type")), F.lit('</b> | <a href="'), link,
             F.lit('">'), title, F.lit("</a>")]
    more = [F.lit("<br><br>"), F.left(F.col("shorter_sentences"), F.lit(TEXT_CAP)), F.lit("<br><br>"), F.coalesce(F.col("entity_spans"), F.lit(""))]
    feedback = [_button(TD_CORRECT, "correct_link", "Correct"), _button(TD_WRONG, "wrong_link", "Wrong")] if internal else []

    def row(summary: bool) -> Column:
        flags = [_flag(summary), _topic()] if internal else []
        return F.concat(F.lit("<tr>"), *flags, *cells, *([] if summary else more), *feedback, F.lit("</td></tr>"))
    return r.select("alert_id", "doc_id", "section", "sec_alias", "sec_doc", "alias_seq", "doc_key", "is_last",
                    row(False).alias("html"), row(True).alias("summary_html"))


def section_counts(results: DataFrame) -> DataFrame:
    """AGG-13: rows per (alert, document type) with the section rank."""
    return (results.groupBy("alert_id", "document_type")
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("section", type_rank(F.col("document_type"))))


def result_counts(results: DataFrame) -> DataFrame:
    """AGG-14: results per alert (digest header)."""
    return results.groupBy("alert_id").agg(F.count(F.lit(1)).alias("n_results"))


ORDER_KEY = ["section", "sec_alias", "sec_doc", "alias_seq", "doc_key"]


def write_digest(rows: DataFrame, path: str, internal: bool = False) -> None:
    """SNK-3: per alert the page with its number of results, the summary table and the document
    table, each with its rows in digest order; a line per row (line breaks in titles become spaces).
    Rows are range-partitioned on (alert, table, order key) and sorted within
    partitions: a large alert spans several ordered part files instead of one
    task, and no alert's digest is assembled in one row or on the driver."""
    rows = cut_lineage(rows.select("alert_id", *ORDER_KEY, "html", "summary_html"))  # read for counts, ranges and rows
    summary, documents = table_heads(internal)
    part = lambda n, html: F.struct(F.lit(n).alias("part"), html.alias("html"))
    frames = rows.groupBy("alert_id").agg(F.count(F.lit(1)).cast("string").alias("n")).select(
        "alert_id", F.lit(0).alias("section"), *[F.lit(0).cast(rows.schema[c].dataType).alias(c) for c in ORDER_KEY[1:]],
        F.explode(F.array(part(0, F.concat(F.lit(PAGE_HEAD[0]), F.col("n"), F.lit(PAGE_HEAD[1] + summary))),
                          part(2, F.lit(TABLE_TAIL + PAGE_MIDDLE + documents)), part(4, F.lit(TABLE_TAIL + PAGE_TAIL)))).alias("p"))
    body = rows.select("alert_id", F.col("section").cast("int").alias("section"), *ORDER_KEY[1:], F.explode(F.array(part(1, F.col("summary_html")), part(3, F.col("html")))).alias("p"))
    keys = ["alert", "part", *ORDER_KEY]
    # sort on the partition column itself so the writer keeps the row order
    (frames.unionByName(body).select(F.col("alert_id").cast("string").alias("alert"), "p.part", *ORDER_KEY, F.regexp_replace("p.html", "[\r\n]+", " ").alias("html"))
        .repartitionByRange(*keys).sortWithinPartitions(*keys)
        .select("alert", "html")
        .write.mode("overwrite").partitionBy("alert").text(path))
