"""Search and tagging semantics on small inline documents."""

from pyspark.sql import functions as F

from curasift.operators.search import search_hits
from curasift.operators.tagging import tag_entities, tag_spans
from curasift.sources import fixtures as fx

DOCS = [(1, "alpha beta gamma"), (2, "beta alpha gamma"), (3, "alpha x y beta"), (4, "gamma only")]


def _docs(spark):
    return spark.createDataFrame(DOCS, "doc_key long, content string")


def _params(spark, rows):
    return spark.createDataFrame(rows, "alert_id int, alias_seq int, keyphrase1 string, keyphrase2 string, "
                                       "keyphrase_distance int")


def _hits(spark, rows):
    h = search_hits(_docs(spark), _params(spark, rows), ["alert_id", "alias_seq"])
    return sorted((r.alert_id, r.doc_key) for r in h.collect())


def test_phrase_and_cooccurrence(spark):
    assert _hits(spark, [(1, 0, "alpha beta", None, None)]) == [(1, 1)]
    assert _hits(spark, [(1, 0, "Alpha", "BETA", None)]) == [(1, 1), (1, 2), (1, 3)]


def test_proximity(spark):
    # distance 0: adjacent and in order only; a swap costs 2; a gap of 2 costs 2
    assert _hits(spark, [(1, 0, "alpha", "beta", 0)]) == [(1, 1)]
    assert _hits(spark, [(1, 0, "alpha", "beta", 2)]) == [(1, 1), (1, 2), (1, 3)]
    assert _hits(spark, [(1, 0, "alpha", "beta", 1)]) == [(1, 1)]


def test_no_sub_longest_match(spark):
    docs = spark.createDataFrame([(1, "We go on the road. On the way, the end.")], "doc_key long, document_text string")
    d = spark.createDataFrame([("on the", "e1", "indication_OME2_txt_ss", None, None, None, None),
                               ("the", "e2", "company_OME_txt_ss", None, None, None, None),
                               ("on the road", "e3", "company_OME_txt_ss", None, None, None, None)],
                              fx.DICTIONARY_SCHEMA)
    spans = sorted((r.start, r.end, r.match_text) for r in tag_spans(docs, d).collect())
    assert spans == [(2, 5, "on the road"), (5, 7, "On the"), (8, 9, "the")]
    # no kept span is contained in another
    for s in spans:
        assert not any(o != s and o[0] <= s[0] and o[1] >= s[1] for o in spans)


def test_two_entities_same_span_and_validity(spark):
    docs = spark.createDataFrame([(1, "TNF and tnf and ED here")], "doc_key long, document_text string")
    d = spark.createDataFrame([("tnf", "t1", "target_OME_txt_ss", None, None, None, None),
                               ("tnf", "c1", "company_OME_txt_ss", None, None, None, None),
                               ("ed", "t2", "target_OME_txt_ss", None, None, None, None)], fx.DICTIONARY_SCHEMA)
    rows = sorted((r.start, r.entity_id, r.match_text, r.valid) for r in tag_entities(docs, d).collect())
    assert rows == [(0, "c1", "TNF", False), (0, "t1", "TNF", True),   # short upper-case: target only
                    (2, "c1", "tnf", False), (2, "t1", "tnf", False),  # lower case: never
                    (4, "t2", "ED", False)]                            # stop-listed alias


def test_sloppy_lone_phrase(spark):
    # QRY-4: head token and the rest of the phrase within the slop
    assert _hits(spark, [(1, 0, "alpha beta", None, 1)]) == [(1, 1)]
    assert _hits(spark, [(1, 0, "alpha beta", None, 2)]) == [(1, 1), (1, 2), (1, 3)]


def test_texts_are_made_once_for_tags_and_text(spark):
    """The pairs and the highlighting read one exchange of the documents' texts."""
    from curasift.plans import registry

    for name in ("jn_8_sentence_pairs", "jn_9_new_targets", "jn_10_new_pairs", "hlt_6_highlight_tags", "hlt_6_highlight_tags_inline", "hlt_7_highlight_tag_lists"):
        df = registry.queries()[name](spark, "/root/testdata/sf0.001")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "REPARTITION_BY_COL" in plan and any("ReusedExchange [doc_key" in x for x in plan.splitlines()), name
        # after the texts nothing else is dealt by the document
        assert not any("Exchange hashpartitioning(doc_key" in x and "ENSURE_REQUIREMENTS" in x for x in plan.splitlines()), name


def test_highlighted_texts_are_held_once(spark):
    """HLT-7's fold holds each match text once, however often it is listed; a null ends it."""
    from curasift.functions.highlight import highlight_tags_from_list

    tags = [("a", "x"), ("b", "y"), ("a", "y"), (None, "x"), ("b", "x"), ("c", "x")]
    schema = "text string, tags array<struct<match_text:string,type:string>>"
    df = spark.createDataFrame([("a b c a", tags), ("c", tags[:3] * 500 + tags[-1:])], schema).repartition(1)
    got = [r[0] for r in df.select(highlight_tags_from_list(df.text, df.tags)).collect()]
    assert "<span class='tag_span x'>a</span>" in got[0] and "<span class='tag_span y'>b</span>" in got[0] and got[0].count("<span") == 3
    assert got[1] == "<span class='tag_span x'>c</span>"
