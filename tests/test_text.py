"""Text functions on inline edge cases the corpus lacks."""

from pyspark.sql import functions as F

from conftest import one
from curasift.functions import snippets as sn
from curasift.functions import text as tx


def test_mask_colon_rule(spark):
    m = lambda s: one(spark, tx.mask_special(F.col("s")), s=s)
    assert m("a:1 b:2") == "a 1 b 2"          # digit after the first colon: all colons go
    assert m("a: b") == "a b"                  # space after it: all go, spaces collapse
    assert m("skin:lump x: 1") == "skin:lump x: 1"   # letter after the first colon: all stay
    assert m("skin lump:") == "skin lump:"     # colon at the end stays
    assert m("C++ (beta)/test") == "C beta test"


def test_mask_subscriptions_keeps_colons(spark):
    assert one(spark, tx.mask_special(F.col("s"), False), s="Headline: a/b") == "Headline: a b"


def test_clean_line_breaks(spark):
    assert one(spark, tx.clean_line_breaks(F.col("s")), s="a\r\nb\tc’s  éx") == "a b c's x"


def test_split_sentences_tail(spark):
    s = "Dr. Smith went home. He slept"
    assert one(spark, tx.split_sentences(F.col("s"), keep_tail=False), s=s) == ["Dr. Smith went home."]
    assert one(spark, tx.split_sentences(F.col("s"), keep_tail=True), s=s) == ["Dr. Smith went home.", "He slept"]
    assert one(spark, tx.split_sentences(F.col("s"), keep_tail=False), s="no terminator here") == []


def test_split_sentences_abbreviations(spark):
    out = one(spark, tx.split_sentences(F.col("s"), keep_tail=False), s="Acme Inc. He left. U.S. rules apply.")
    # a suffix before a sentence starter becomes a stop and loses its period
    assert out == ["Acme Inc", "He left.", "U.S. rules apply."]


def test_sections(spark):
    s = "Headline: x Content: y Link: z Date: w"
    marked = one(spark, tx.mark_sections(F.col("s")), s=s)
    assert marked == " || Headline: x  || Content: y  || Link: z  || Date: w"
    kept = one(spark, tx.keep_sections(tx.mark_sections(F.col("s"))), s=s)
    assert kept == "Headline: x  Content: y  Date: w"


def test_whole_word_count(spark):
    c = lambda t, k: one(spark, tx.count_whole_word(F.lower(F.col("t")), F.lower(F.col("k"))), t=t, k=k)
    assert c("the theme, the. THE", "the") == 3
    assert c("on the road on the", "on the") == 2
    assert c("a.b a.b", "a.b") == 2            # regex metacharacters are literal
    assert c("anything", "") == 0


def test_snippet_separators(spark):
    snip = lambda t, k: one(spark, sn.keyword_snippet(F.col("t"), F.col("k")), t=t, k=k)
    assert snip("Alpha one. The beta two. Gamma three.", "beta") == " The beta two."
    assert snip("Beta one. Alpha two. Beta three.", "beta") == "Beta one. ... Beta three."
    assert snip("Alpha one. Gamma two. Beta three.", "beta") == " ... Beta three."


def test_snippet_soft_cap(spark):
    s = ("beta " + "x" * 295 + ". ") * 3
    out = one(spark, sn.keyword_snippet(F.col("t"), F.col("k")), t=s, k="beta")
    pieces = out.split(" beta ")
    assert out.count("beta") == 2          # the third piece starts after 500 characters
    assert len(pieces) == 2
    assert len(out) - len(" beta " + "x" * 295 + ".") < 500   # kept length minus last piece < cap


def test_splitter_scans_for_full_stops(spark):
    """No rule of the splitter tries a group of letters at every place, and no sentence is cleaned on its own."""
    df = spark.createDataFrame([("x",)], "s string").select(tx.document_text(F.col("s")).alias("v"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace(" in plan and "([A-Za-z])[.]([A-Za-z])[.]," not in plan and "(Mr|St|Mrs|Ms|Dr)[.]," not in plan
    assert plan.count("x7F") == 1


def test_splitter_rules_as_passes(spark):
    split = lambda s: one(spark, tx.split_sentences(F.col("s")), s=s)
    assert split("U.S.A. However it b. c. d.") == ["U.S.A.", "However it b. c. d."]
    assert split('He said "no." Then') == ['He said "no".', "Then"]
    assert split("Mrs. A. at x.com now. B") == ["Mrs. A. at x.com now.", "B"]
    assert split("") == [] and split("\u00e9") == ["\u00e9"] and split(None) is None
    # spaces collapse before characters outside ASCII go
    assert one(spark, tx.text_to_sentences(F.col("s")), s="\u00e9 \u00e9! b\tc") == [" !", "b c"]
    assert one(spark, tx.document_text(F.col("s")), s="\u00e9! b\tc") == "! b c"
