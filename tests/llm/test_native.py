import os

import duckdb
import pytest
from brute import SF_SMALL
from pyspark.sql import functions as F
from llm_fixtures import edge, llm_spark, nothing  # noqa: F401  (fixtures)

from curasift.llm import chat_format, sharding, url_filter
from curasift.llm import queries as Q


def _equal(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{os.path.join(sf, t)}.parquet'")
    got, want = Q.queries()[name](spark, sf).toPandas(), con.execute(Q.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want) > 0
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(llm_spark, name):
    _equal(llm_spark, name, SF_SMALL)


def test_periodic_runs_equal_sql_by_value(llm_spark):
    """Null numbers are compared as nulls, whatever type pandas would give their columns."""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_SMALL}/documents.parquet'")
    got = Q.op12_periodic_runs(llm_spark, SF_SMALL)
    want = con.execute(Q.oracle_sql()["op12_periodic_runs"])
    at = [got.columns.index(x[0]) for x in want.description]
    rows = [tuple(r[i] for i in at) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want.fetchall(), key=repr) and any(None in r for r in rows)


def test_cascade_is_exact(llm_spark):
    universe = llm_spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where(F.crc32("key") % 5 == 0).unionByName(llm_spark.createDataFrame([("outside",), (None,)], "key string"))
    for bits in (url_filter.MAX_BITS, 10_000):
        cascade = url_filter.Cascade(listed, universe, rate=1 / 4, later_rate=1 / 4, max_bits=bits)
        assert len(cascade.levels[0]) > 4 and (cascade.blocks > 1) == (bits < url_filter.MAX_BITS)
        rows = universe.unionByName(listed.where("key is null or key = 'outside'"))
        got = cascade.judge(rows, F.col("key"), "m")
        assert got.count() == 20_002
        assert got.where("m <> coalesce(key = 'outside' or (key like 'k%' and crc32(key) % 5 = 0), false)").count() == 0
        assert not any("Join" in str(x) for x in got._jdf.queryExecution().executedPlan().toString().split("\n"))


def test_cascade_of_an_empty_list(llm_spark):
    universe = llm_spark.range(50).select(F.col("id").cast("string").alias("key"))
    cascade = url_filter.Cascade(universe.limit(0), universe)
    assert cascade.judge(universe, F.col("key"), "m").where("m").count() == 0


def test_urls(llm_spark):
    urls = ["http://WWW.Example.com/en/1?x=://y", "https://a.example.com/en/", "http://example.com/enx", "ftp://x.NET/fr/2#f", None, "", "no scheme", "http://", "http://net/es/", "http://xnet/es/", "http://a.com", "x://y://z.com/p", "http://É.org/p?q"]
    pages = llm_spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = llm_spark.createDataFrame([("É.org/p",)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, Q.URL_RULES, listed).collect()}
    assert got == {0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 1: ("a.example.com", "/en/", "example.com/en/", "block"), 2: ("example.com", "/enx", "com/", "allow"),
                   3: ("x.net", "/fr/2", "net/fr/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
                   8: ("net", "/es/", "net/es/", "block"), 9: ("xnet", "/es/", None, "allow"), 10: ("a.com", "", None, "allow"), 11: ("y:", "//z.com/p", None, "allow"), 12: ("É.org", "/p", None, "block")}
    assert url_filter.judge_urls(pages.limit(0), Q.URL_RULES, listed).count() == 0


def _check_shards(frame, docs, shards=8):
    got = frame.toPandas()
    assert len(got) == docs.count()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    return got


def test_shards(llm_spark, edge, nothing):
    import zlib
    docs = llm_spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = _check_shards(sharding.assign_shards(docs), docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got.itertuples())
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= got["size"].max()
    assert _check_shards(sharding.assign_shards(edge), edge).law.eq("bytes").all()
    assert sharding.assign_shards(nothing).count() == 0
    again = sharding.assign_shards(docs.repartition(5)).toPandas().sort_values("doc_id")
    assert (again.set_index("doc_id").shard == got.set_index("doc_id").shard.sort_index()).all()


def test_shards_of_a_hot_group(llm_spark):
    docs = llm_spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text " * 20)).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    sizes = _check_shards(sharding.assign_shards(docs), docs).groupby("shard")["size"].sum()
    assert sizes.max() < 1.05 * sizes.mean() and sizes.min() > 0.95 * sizes.mean()


def test_shards_of_equal_rows(llm_spark):
    """Rows equal in text and id, with and without an id, hold two thirds of all bytes."""
    docs = llm_spark.range(3000).selectExpr("case when id % 3 = 0 then id when id % 3 = 1 then 7 end doc_id", "case when id % 3 = 0 then concat('text ', id) else 'the same text' end text")
    sizes = _check_shards(sharding.assign_shards(docs), docs).groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() < 1.2 * sizes.min()


def test_shards_of_few_large_records(llm_spark):
    """Rounds end although single records are larger than a range."""
    docs = llm_spark.range(400).selectExpr("id doc_id", "repeat(char(97 + id % 26), case when id % 50 = 0 then 200000 else 1 + id end) text")
    sizes = _check_shards(sharding.assign_shards(docs), docs).groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() < 2.2 * sizes.min()


def test_written_shards_keep_rows(llm_spark, tmp_path):
    """Repeated rows are written as often as they come, whatever their columns are called."""
    docs = llm_spark.range(500).selectExpr("7L doc_id", "'the same text' text", "id shard", "id h", "id t", "id row")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    got = llm_spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    n = [r["count"] for r in got.groupBy("shard_").count().collect()]
    assert len(n) == 4 and max(n) < 1.5 * min(n)


def test_written_shards(llm_spark, edge, tmp_path):
    sharding.write_shards(edge.drop("shard"), str(tmp_path / "out"), 3)
    assert llm_spark.read.parquet(str(tmp_path / "out")).count() == edge.count()


def test_preferences(llm_spark):
    schema = "pair_id long, turn long, role string, text string"
    a = llm_spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "good <|x"), (2, 0, "user", "q"), (3, 0, None, None), (3, 0, "user", "z"), (None, 0, "user", "n")], schema)
    b = llm_spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", "u"), (2, 0, "user", "q"), (4, 0, "assistant", "only")], schema)
    got = {r.pair_id: r for r in chat_format.format_preferences(a, b).collect()}
    one = got[1]
    assert one.n_common == 1 and one.prompt == "<|user|>\nq<|end|>\n" and one.chosen == "<|assistant|>\ngood < |x<|end|>\n"
    start, end = map(int, one.chosen_mask.split("-"))
    assert one.chosen[start:end] == "good < |x<|end|>\n" and one.rejected_mask == "14-25"
    assert got[2].n_common == 1 and got[2].chosen == got[2].rejected == "" and got[3].n_common == 0 and got[3].rejected == ""
    assert got[4].chosen == "" and got[4].rejected_mask == "14-26" and got[None].chosen == "<|user|>\nn<|end|>\n"
    assert chat_format.format_preferences(a.limit(0), b.limit(0)).count() == 0
    turns = a.withColumnRenamed("pair_id", "conv_id")
    assert chat_format.format_preferences(*chat_format.stale_reply_pairs(turns)).count() == 4


def test_pairs_without_a_preference(llm_spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "q"), (2, 1, "assistant", "same"), (2, 2, "user", "r"), (2, 3, "assistant", "same"),
            (3, 0, "user", "q"), (3, 1, "assistant", "old"), (3, 2, "assistant", "new")]
    turns = llm_spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat_format.format_preferences(*chat_format.stale_reply_pairs(turns)).collect()}
    whole = lambda i: "".join(f"<|{r}|>\n{t}<|end|>\n" for c, _, r, t in rows if c == i)
    for i, n in ((1, 2), (2, 4)):
        assert got[i].n_common == n and got[i].prompt == whole(i)
        assert got[i].chosen == got[i].rejected == got[i].chosen_mask == got[i].rejected_mask == ""
    assert got[3].n_common == 2 and got[3].chosen == "<|assistant|>\nnew<|end|>\n" and got[3].rejected == "<|assistant|>\nold<|end|>\n"
    assert got[3].chosen_mask == got[3].rejected_mask == "14-25"
