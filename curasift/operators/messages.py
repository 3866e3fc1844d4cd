"""Mailbox operators (MSG-1..3), re-aimed from the mail client to a
``messages`` table (mailbox, msg_id, ts, seen, sender, body)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: marker of the quoted trail of a reply (blank line + year).
QUOTE_MARKER = "\r\n\r\n2015"


def with_word(messages: DataFrame, word: str) -> DataFrame:
    """MSG-1: messages whose lower-cased body contains ``word``."""
    return messages.where(F.contains(F.lower(F.col("body")), F.lit(word)))


def latest(messages: DataFrame, state: str = "all", since=None) -> DataFrame:
    """MSG-2: latest message of each mailbox in a state ('seen', 'unseen',
    'all'), optionally since a time; ``max_by`` keeps it one aggregation
    (partial aggregation before the shuffle, no group collected)."""
    m = messages
    if state == "seen":
        m = m.where(F.col("seen"))
    elif state == "unseen":
        m = m.where(~F.col("seen"))
    if since is not None:
        m = m.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    return m.groupBy("mailbox").agg(F.max_by(F.struct("msg_id", "ts", "sender"), F.struct("ts", "msg_id")).alias("m")) \
            .select("mailbox", "m.msg_id", "m.ts", "m.sender")


def body_without_trail(messages: DataFrame, marker: str = QUOTE_MARKER) -> DataFrame:
    """MSG-3: body cut at the first repeat of the sender, then at the quote
    marker."""
    b = F.when(F.length("sender") > 0, F.split_part(F.col("body"), F.col("sender"), F.lit(1))).otherwise(F.col("body"))
    return messages.select("mailbox", "msg_id", F.split_part(b, F.lit(marker), F.lit(1)).alias("body_clean"))
