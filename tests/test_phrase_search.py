"""Phrase search against brute force: sloppy phrases, proximity, and the anchor join
with and without a broadcast."""

import itertools
import random
import re
import time
from statistics import median

from pyspark.sql import functions as F

from curasift.operators import search as se


def _words(text):
    return re.findall("[a-z0-9_]+", text.lower())


def sloppy(words, phrase, slop):
    places = [[i for i, w in enumerate(words) if w == p] for p in phrase]
    for chosen in itertools.product(*places):
        shifts = [p - k for k, p in enumerate(chosen)]
        if len(set(chosen)) == len(chosen) and max(shifts) - min(shifts) <= slop:
            return True
    return False


def near(words, first, second, distance):
    starts = lambda ph: [i for i in range(len(words)) if words[i:i + len(ph)] == ph]
    return any(abs(b - a - len(first)) <= distance for a in starts(first) for b in starts(second))


def _texts(n, size, letters, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(letters) for _ in range(r.randint(0, size))) for _ in range(n)]


def _search(spark, texts, rows):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_key long, content string")
    params = spark.createDataFrame(rows, "alert_id int, keyphrase1 string, keyphrase2 string, keyphrase_distance int")
    return {(r.alert_id, r.doc_key) for r in se.search_hits(docs, params, ["alert_id"]).collect()}


def test_sloppy_phrases(spark):
    texts = [*_texts(150, 14, "abcdefgh", 1), "", None, "a", "b a", "a b"]
    phrases = ["a b", "a a", "a b c", "a b a", "c a a b", "a a a", "d c b a", "a", "A, b!", ""]
    rows = [(10 * i + slop, p, None, slop) for i, p in enumerate(phrases) for slop in range(7)]
    want = {(k, d) for k, p, _, slop in rows for d, t in enumerate(texts) if _words(p) and sloppy(_words(t or ""), _words(p), slop)}
    assert _search(spark, texts, rows) == want


def test_proximity(spark):
    texts = [*_texts(150, 16, "abcd", 2), "", "a b"]
    pairs = [("a", "b"), ("a b", "c"), ("c", "a b"), ("a", "a"), ("a b", "b c d"), ("b b", "a")]
    rows = [(10 * i + n, a, b, n) for i, (a, b) in enumerate(pairs) for n in range(5)]
    want = {(k, d) for k, a, b, n in rows for d, t in enumerate(texts) if near(_words(t), _words(a), _words(b), n)}
    assert _search(spark, texts, rows) == want


def test_long_text_of_two_words(spark):
    """Places are merged once, so 10,000 of each take seconds, not 10^8 comparisons."""
    text = "ab cd " * 10_000
    start = time.time()
    got = _search(spark, [text, text + " ef"], [(1, "ab", "cd", 0), (2, "cd cd", None, 1), (3, "cd cd", None, 0), (4, "ef", "ab", 3), (5, "ab ab cd", None, 3)])
    assert got == {(1, 0), (1, 1), (2, 0), (2, 1), (4, 1), (5, 0), (5, 1)} and time.time() - start < 60


def test_same_occurrences_without_broadcast(spark):
    texts = [*_texts(200, 40, ["the", "Of", "road", "x1", "kinase"], 3), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_key long, content string").repartition(5)
    phrases = spark.createDataFrame([("the",), ("the of",), ("of THE road",), ("road kinase the x1",), ("absent the",), ("",), (None,), ("of of",)], "phrase string")
    want = {(d, " ".join(p), i) for d, t in enumerate(texts) for p in (["the"], ["the", "of"], ["of", "the", "road"], ["road", "kinase", "the", "x1"], ["of", "of"])
            for i in range(len(_words(t or ""))) if _words(t or "")[i:i + len(p)] == p}
    for bound in (32 << 20, 0):
        got = se.phrase_occurrences(docs, phrases, with_text=True, max_bytes=bound)
        rows = got.collect()
        assert len(rows) == len(want) and {(r.doc_key, r.phrase, r.start) for r in rows} == want
        assert all(r.match_text.lower() == r.phrase and r.n == len(r.phrase.split()) for r in rows)
    assert se.phrase_occurrences(docs, phrases.limit(0)).count() == 0


def test_anchor_is_the_rarest_token(spark):
    freq = spark.createDataFrame([("the", 1000), ("road", 3), ("of", 800)], "w string, n long")
    table = se.phrase_table(spark.createDataFrame([("the road of",), ("of the",), ("road",), ("unseen the",)], "phrase string"))
    assert {(r.phrase, r.w, r.off) for r in se.anchored(table, freq).collect()} == {("the road of", "road", 1), ("of the", "of", 0), ("road", "road", 0), ("unseen the", "unseen", 0)}
    assert {(r.phrase, r.w, r.off) for r in se.anchored(table).collect()} == {("the road of", "road", 1), ("of the", "the", 1), ("road", "road", 0), ("unseen the", "unseen", 0)}


def test_hot_token_is_dealt_over_tasks(spark):
    """One word is a third of all tokens and is itself a phrase: without a broadcast the
    anchor join still has no task with over twice the median rows."""
    r = random.Random(4)
    texts = [" ".join("the" if r.random() < 1 / 3 else f"w{r.randrange(400)}" for _ in range(400)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_key long, content string")
    table = se.phrase_table(spark.createDataFrame([("the",), *((f"the w{i}",) for i in range(400))], "phrase string"))
    freq = se.token_frequencies(docs)
    tokens = se.token_starts(docs, ["doc_key"], "content", 1, 2)
    dealt, copied = se.salted(tokens, se.anchored(table, freq), freq, ["doc_key", "at"])
    assert dealt.count() == tokens.count() and copied.where("w = 'the'").count() > 300
    sizes = [x["count"] for x in dealt.repartition(16, "w", "salt").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * median(sizes)


def test_no_start_that_is_no_anchor_is_exploded(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h b")], "doc_key long, content string")
    assert [(r.at, r.w, r._g) for r in se.token_starts(docs, ["doc_key"], "content", 1, 2, ["b"]).collect()] == [(1, "b", ["a", "b", "c"]), (8, "b", ["h", "b"])]
