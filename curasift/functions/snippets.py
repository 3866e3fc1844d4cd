"""Keyword mention counts and keyword snippets (AGG-1, SNP-1/2/3, WIN-3/4) as
Column expressions over one document's text.

The reference walks the sentences with two pieces of carried state (the
previous matching sentence and the snippet length).  Here the matching
sentence indexes form an array; the separator of each piece looks at the
previous index (WIN-3, a lag over the array) and the length cap is a fold
(WIN-4) -- all inside one row, so no shuffle is needed however long the
document is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curasift.functions import text as tx

SNIPPET_SOFT_CAP = 500   # fixed value: a piece is added only while the snippet is shorter


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyword_count(doc_text, kw, subscriptions: bool = False) -> Column:
    """AGG-1: whole-word, case-insensitive, non-overlapping mentions of the
    masked keyword in the masked document text."""
    colon = not subscriptions
    t = F.lower(tx.mask_special(doc_text, colon))
    k = F.lower(tx.mask_special(kw, colon))
    return tx.count_whole_word(t, k)


def matching_sentences(sentences, kw_lower) -> Column:
    """Indexes (0-based) of the sentences containing the keyword (substring
    test, so a snippet can exist with a zero whole-word count: Q-2)."""
    return F.filter(F.transform(_col(sentences),
                                lambda s, i: F.when(F.contains(F.lower(s), kw_lower), i).otherwise(-1)),
                    lambda i: i >= 0)


def snippet_pieces(sentences, idx, mark: bool = False) -> Column:
    """WIN-3: piece k = separator + sentence; separator '' at sentence 0,
    ' ' when the previous matching index (0 before the first) is adjacent,
    else ' ... '."""
    S = _col(sentences)

    def piece(i, k):
        prev = F.when(k == 0, F.lit(0)).otherwise(F.get(idx, k - 1))
        sep = F.when(i == 0, F.lit("")).when(i == prev + 1, F.lit(" ")).otherwise(F.lit(" ... "))
        s = F.get(S, i)
        return F.concat(sep, tx.mark_sections(s) if mark else s)
    return F.transform(idx, piece)


def capped_concat(pieces, cap: int = SNIPPET_SOFT_CAP) -> Column:
    """WIN-4: append a piece only while the text so far is shorter than cap."""
    return F.aggregate(_col(pieces), F.lit(""),
                       lambda acc, p: F.when(F.length(acc) < cap, F.concat(acc, p)).otherwise(acc))


def keyword_snippet(doc_text, kw, subscriptions: bool = False) -> Column:
    """SNP-1 (subscriptions=False) / SNP-2 (True): the sentences of the masked
    document text that contain the masked keyword, joined as in the
    reference; subscription snippets get section marks.

    For DataFrames prefer ``with_keyword_snippet``, which stages the sentence
    array in a column so lambdas do not re-evaluate it."""
    colon = not subscriptions
    masked = tx.mask_special(doc_text, colon)
    k = F.lower(tx.mask_special(kw, colon))
    sents = tx.text_to_sentences(masked)
    idx = matching_sentences(sents, k)
    return capped_concat(snippet_pieces(sents, idx, mark=subscriptions))


def with_keyword_snippet(df, doc_text: str, kw: str, sub_flag: Column, out: str = "snippet"):
    """SNP-3 on a DataFrame: MSK-1 or MSK-2 by ``sub_flag``, then SNP-1/2.
    Intermediate arrays are real columns (computed once per row)."""
    masked = F.when(sub_flag, tx.mask_special(doc_text, False)).otherwise(tx.mask_special(doc_text, True))
    kmask = F.when(sub_flag, tx.mask_special(kw, False)).otherwise(tx.mask_special(kw, True))
    df = (df.withColumn("_sents", tx.text_to_sentences(masked))
            .withColumn("_kwl", F.lower(kmask)))
    df = df.withColumn("_idx", matching_sentences("_sents", F.col("_kwl")))
    df = df.withColumn("_pieces", F.when(sub_flag, snippet_pieces("_sents", F.col("_idx"), True))
                       .otherwise(snippet_pieces("_sents", F.col("_idx"), False)))
    return df.withColumn(out, capped_concat("_pieces")).drop("_sents", "_kwl", "_idx", "_pieces")


def with_snippet_from_sentences(df, sentences: str, kw_lower: str, sub_flag: Column, out: str = "snippet"):
    """SNP-1/2 from an already split, masked sentence array column and the
    masked, lower-cased keyword column (staged columns: computed once)."""
    df = df.withColumn("_idx", matching_sentences(sentences, F.col(kw_lower)))
    df = df.withColumn("_pieces", F.when(sub_flag, snippet_pieces(sentences, F.col("_idx"), True))
                       .otherwise(snippet_pieces(sentences, F.col("_idx"), False)))
    return df.withColumn(out, capped_concat("_pieces")).drop("_idx", "_pieces")
