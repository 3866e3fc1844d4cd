"""Preference formatting: paired conversations as one prompt and two masked completions.

For each pair the longest common prefix of turns (equal role and text, in turn order) of the
chosen and the rejected conversation is rendered once, as the prompt; the rest of each is its
completion.  A mask lists the character spans of a completion that are learned from: the texts
and end marks of its assistant turns.  Only built-in functions are used, with one shuffle by
pair.  One pair is one training example and one row, so a row is as long as its conversation.

Defined results: null role and null text count as empty; a conversation without the pair's
other side yields a row whose missing side has no turns; turns with equal numbers are ordered
by role and text; repeated rows are repeated turns; template marks inside texts are broken by
a space, so that no text can pass for a turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "<|end|>\n"


def _side(turns: DataFrame, name: str) -> DataFrame:
    return turns.select("pair_id", F.lit(name).alias("side"), F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(turn["role"], F.lit(OPEN), F.lit("< |")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.replace(turn["text"], F.lit(OPEN), F.lit("< |")), F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    """Learned spans ``start-end`` of the rendered turns, comma-joined."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_head(t))
        end = start + F.length(_body(t))
        span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step, lambda acc: F.array_join(acc["spans"], ","))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask; both frames
    have pair_id, turn, role and text."""
    rows = _side(chosen, "c").unionByName(_side(rejected, "r"))
    sides = rows.groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("t")))).alias(s) for s in ("c", "r")])
    both = F.least(F.size("c"), F.size("r"))
    differ = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(differ, False).cast("int")
    cut = sides.withColumn("n_common", F.when(first > 0, first - 1).otherwise(both))
    rest = lambda s: F.slice(s, F.col("n_common") + 1, F.greatest(F.size(s) - F.col("n_common"), F.lit(0)))
    parts = cut.select("pair_id", "n_common", F.slice("c", 1, F.col("n_common")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return parts.select("pair_id", "n_common", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"),
                        _render(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"))


def stale_reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides from plain conversations: the rejected side answers last with
    the first assistant text of the conversation, or, if that is its only one, echoes the text
    of its first turn.  ``pair_id`` is the conversation's id.

    The sides differ in the last assistant turn only.  A conversation without an assistant turn,
    or whose last assistant text equals the stale one, has equal sides: a pair without a
    preference.  ``format_preferences`` keeps it as a row with the whole conversation as the
    prompt, and empty completions and masks; training on preferences has to leave out rows
    whose ``chosen`` equals ``rejected``."""
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    said = F.col("role") == "assistant"
    key = F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))
    ends = turns.groupBy("pair_id").agg(F.max(F.when(said, F.col("turn"))).alias("_last"), F.min(F.when(said, key)).alias("_first"), F.min(key).alias("_open"))
    other = F.when(F.col("_first.turn") < F.col("_last"), F.col("_first.text")).otherwise(F.col("_open.text"))
    joined = turns.join(ends.withColumnRenamed("pair_id", "_pair"), F.col("pair_id").eqNullSafe(F.col("_pair")), "left")
    text = F.when(said & (F.col("turn") == F.col("_last")), other).otherwise(F.col("text"))
    return turns, joined.select("pair_id", "turn", "role", text.alias("text"))
