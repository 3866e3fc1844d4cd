"""Stored tables: articles by day, daily statistics by date, known pairs by version, postings."""

import datetime as dt

from pyspark.sql import functions as F

from curasift.operators import postings as po
from curasift.operators.search import bm25_top_k
from curasift.plans import stats as st
from curasift.sources import article_store as ar
from curasift.sources import fixtures as fx
from curasift.sources import known_store as ks

SF = "/root/testdata/sf0.001"


def _keys(df):
    return sorted(r.doc_key for r in df.select("doc_key").collect())


def test_article_store(spark, tmp_path):
    arts = fx.articles(spark, SF)
    for form in ("parquet", "json"):
        path = str(tmp_path / form)
        ar.write_articles(arts, path, form)
        some = ar.read_articles(spark, path, "2024-01-05", "2024-01-06", form)
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(modified_date" in plan and "2024-01-05" in plan.split("PartitionFilters")[1].split("]")[0]
        want = arts.where("file_modified_date between date '2024-01-05' and date '2024-01-06'")
        assert sorted(map(str, some.collect())) == sorted(map(str, want.select(*some.columns).collect())) and some.count() > 0
    days = spark.createDataFrame([(dt.date(2024, 1, 7),), (None,), (dt.date(1999, 1, 1),)], "date date")
    assert _keys(ar.articles_of_days(spark, path, days, "json")) == _keys(arts.where("file_modified_date = date '2024-01-07'"))
    # a day written again replaces that day alone
    before = _keys(ar.read_articles(spark, path, None, "2024-01-06", "json"))
    ar.write_articles(arts.where("file_modified_date = date '2024-01-07' and doc_key < 100"), path, "json")
    assert _keys(ar.read_articles(spark, path, "2024-01-07", "2024-01-07", "json")) == _keys(arts.where("file_modified_date = date '2024-01-07' and doc_key < 100"))
    assert _keys(ar.read_articles(spark, path, None, "2024-01-06", "json")) == before


def test_daily_stats_leave_other_days(spark, tmp_path):
    arts, path = fx.articles(spark, SF), str(tmp_path / "stats")

    def write(day):
        st.write_daily_stats(st.day_documents(arts, day, day), arts, fx.dictionary(spark), fx.known_pairs(spark), path)
        rows = spark.read.schema("key string, name string, path string, n long, date_key string").json(path).collect()
        return {d: sorted(map(str, (r for r in rows if r.date_key == d))) for d in {r.date_key for r in rows}}

    first = write("2024-01-03")
    assert list(first) == ["2024-01-03"]
    both = write("2024-01-04")
    assert sorted(both) == ["2024-01-03", "2024-01-04"] and both["2024-01-03"] == first["2024-01-03"]


def test_known_pairs_grow_by_version(spark, tmp_path):
    path = str(tmp_path / "pairs")
    frame = lambda rows: spark.createDataFrame(rows, "moa string, indication string")
    known = lambda v=None: {tuple(r) for r in ks.read_known_pairs(spark, path, v).collect()}
    ks.write_known_pairs(frame([("a", "x"), ("a", "x"), (None, "y")]), path)
    ks.merge_known_pairs(spark, path, frame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")]), 1)
    assert known(0) == {("a", "x")} and known(1) == known() == {("a", "x"), ("a", "y"), ("b", "x")}
    ks.merge_known_pairs(spark, path, frame([("b", "x"), ("c", "z")]), 2)
    ks.merge_known_pairs(spark, path, frame([("a", "y")]), 1)  # the first merge again, with fewer pairs
    assert known(1) == {("a", "x"), ("a", "y")} and known() == {("a", "x"), ("a", "y"), ("c", "z")}
    assert spark.read.parquet(path).where("version = 2").count() == 1


def test_postings(spark, tmp_path):
    texts = ["a b a", "b c", None, "", "A a a d", "c c c c b a", "zeta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_key long, content string")
    queries = spark.createDataFrame([(1, "a c"), (2, "Zeta, b b"), (3, "absent"), (4, "")], "query_id int, query string")
    path = str(tmp_path / "index")
    po.write_postings(docs, path)
    got = po.search_postings(spark, path, queries, 3)
    want = bm25_top_k(docs.fillna("", ["content"]), queries, 3)
    columns = ["query_id", "doc_key", "score", "rank"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) and got.count() > 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1]
    rows = spark.read.parquet(f"{path}/postings").where(F.col("w") == "a").collect()
    assert {(r.doc_key, r.tf, r.dl) for r in rows} == {(0, 2, 3), (4, 3, 4), (5, 1, 6)}
