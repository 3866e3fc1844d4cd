"""FUZ-1 against a plain-Python LCS on small strings (brute force)."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from curasift.functions import fuzzy
from curasift.operators import alerts


def lcs(a: str, b: str) -> int:
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def expected_ratio(a: str, b: str) -> int:
    if not a or not b:
        return 0
    return round(200.0 * lcs(a, b) / (len(a) + len(b)))


def test_known_values(spark):
    df = spark.createDataFrame([("smal ring", "small ring"), ("Customer#00000012", "Customer#000000012"),
                                ("", "x"), ("abc", "abc")], "a string, b string")
    got = [r[0] for r in df.select(fuzzy.ratio("a", "b")).collect()]
    assert got == [95, 97, 0, 100]


@settings(max_examples=5, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.text("abcde ", max_size=9), st.text("abcde ", max_size=9)), min_size=40, max_size=40))
def test_against_python(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [tuple(r) for r in df.select("a", "b", fuzzy.ratio("a", "b").alias("r")).collect()]
    for a, b, r in got:
        assert r == expected_ratio(a, b), (a, b)


def test_long_strings(spark):
    """More characters than one long has bits, with carries between the longs."""
    r = random.Random(3)
    words = ["".join(r.choice("abAB é#0") for _ in range(n)) for n in (61, 62, 63, 64, 124, 125, 190, 300, 1)] + ["a" * 200, "ab" * 100, ""]
    pairs = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r == expected_ratio(a, b) for a, b, r in df.select("a", "b", fuzzy.ratio("a", "b")).collect())


def _names(r, n):
    syllables = ["smal", "ring", "bolt", "giz", "mo", "blue", "Cust", "omer", "#0", "01", "2", " ", "é", "x"]
    return sorted({"".join(r.choice(syllables) for _ in range(r.randint(0, 5))) for _ in range(n)})


@pytest.mark.parametrize("leeway", [-1, 0, 30, 70, 90, 99, 100, 250])
def test_filter_loses_no_match(spark, leeway):
    r = random.Random(leeway)
    values, patterns = _names(r, 120), _names(r, 25)
    v = spark.createDataFrame([(k, f, x) for k, f in ((1, "j"), (2, "a")) for x in values], "alert_id int, f string, value string")
    p = spark.createDataFrame([(1, "j", x, leeway) for x in patterns] + [(2, "a", x, leeway) for x in patterns[:3]] + [(3, "j", "unused", leeway)], "alert_id int, f string, pattern string, filter_leeway int")
    possible = alerts.possible_pairs(v, p)
    got = {(x.alert_id, x.f, x.value, x.pattern) for x in possible.join(alerts.fuzzy_pairs(possible), ["value", "pattern"]).where("score > filter_leeway").collect()}
    want = {(k, f, a, b) for k, f, own in ((1, "j", patterns), (2, "a", patterns[:3])) for a in values for b in own if expected_ratio(b, a) > leeway}
    assert got == want


def test_few_pairs_are_scored(spark):
    """2,000 values and 30 patterns are 60,000 pairs; only those that can match are scored."""
    r = random.Random(9)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    values = ["".join(r.choice(alphabet) for _ in range(r.randint(8, 30))) for _ in range(2000)]
    patterns = [x[:3] + x[4:] for x in values[:30]]
    v = spark.createDataFrame([(1, "j", x) for x in values], "alert_id int, f string, value string")
    p = spark.createDataFrame([(1, "j", x, 85) for x in patterns], "alert_id int, f string, pattern string, filter_leeway int")
    possible = alerts.possible_pairs(v, p)
    scored = alerts.fuzzy_pairs(possible)
    assert scored.where("score > 85").count() >= 30 and scored.count() < 600
