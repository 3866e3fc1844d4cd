"""The digest's pages: two tables per alert, rows in digest order, nothing lost over many partitions."""

import glob
import re

from pyspark.sql import functions as F

from curasift.plans import digest as dg

SCHEMA = """alert_id int, doc_id string, alias_seq int, doc_key long, keyword string, keyword_count int, document_type string, title string,
path string, shorter_sentences string, entity_spans string, relevant_check string, topic_class string, correct_link string, wrong_link string"""


def _results(spark):
    kinds = ["newswire", "pubmed_article", "press_release", "own_kind", "other_kind"]
    rows = [(a, f"/d{i}", i % 2, i, "kw", i, kinds[i % 5], f"Title\n{i:03}", "/p q", "s" * 1200, None if i % 3 else "<span>e</span>",
             ("Relevant (60%)", "NR (10%)", "No Eval")[i % 3], ("relevant", "not relevant", "Not Evaluated", "x")[i % 4], "http://c" if i % 2 else "", "") for a in (1, 2) for i in range(30 * a)]
    return spark.createDataFrame(rows, SCHEMA)


def _page(path, alert):
    files = sorted(glob.glob(f"{path}/alert={alert}/part-*"))
    return len(files), "\n".join(open(f).read() for f in files)


def test_pages(spark, tmp_path):
    results = _results(spark).repartition(7)
    for internal in (False, True):
        path = str(tmp_path / str(internal))
        rows = dg.digest_rows(results, "ana", internal)
        dg.write_digest(rows, path, internal)
        for alert, n in ((1, 30), (2, 60)):
            _, page = _page(path, alert)
            head = f"<html><head></head><body><h4>Summary ({n} results)</h4>" + dg.table_heads(internal)[0]
            assert page.startswith(head) and page.rstrip("\n").endswith("</tbody></table></body></html>")
            summary, documents = page.split(dg.PAGE_MIDDLE)
            titles = [re.findall(r"Title (\d+)</a>", part) for part in (summary, documents)]
            want = [f"{r.doc_key:03}" for r in rows.where(F.col("alert_id") == alert).orderBy(*dg.ORDER_KEY).collect()]
            assert titles[0] == titles[1] == want and len(want) == n
            assert "s" * 1000 in documents and "s" * 1001 not in documents and "sss" not in summary
            assert ("Relevant? - IM" in page) == ("Correct?" in page) == internal
            # the heavier rule under the last row of each of five sections, in each table
            assert page.count(dg.TD_BODY_LAST) == (0 if internal else 10)


def test_sections(spark):
    rows = dg.digest_rows(_results(spark).where("alert_id = 1"), "ana").orderBy(*dg.ORDER_KEY).collect()
    kinds = [re.search(r"<b>([^<]*)</b>", r.html)[1] for r in rows]
    assert list(dict.fromkeys(kinds)) == ["Press Release", "Pubmed Article", "Newswire", "Other Kind", "Own Kind"]
    assert [r.is_last for r in rows].count(True) == 5 and kinds == sorted(kinds, key=list(dict.fromkeys(kinds)).index)
