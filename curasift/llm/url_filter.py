"""URL filters: ordered host/path rules, and a Bloom filter cascade for exact list membership.

The cascade knows the corpus's complete key universe.  Level 1 is a Bloom filter of the listed
keys; level 2 one of the unlisted keys that level 1 wrongly lets through; level 3 one of the
listed keys that level 2 lets through; and so on until no wrong answer is left.  A key is
answered by the first level that does not contain it: an odd level says unlisted, an even one
listed.  For every key of the universe this is exact, and asking needs no join: the filters
are bit arrays in the expression.

The filters of one block of the key space (by hash) have ``MAX_BITS`` bits at most for the
listed keys; a larger list is split into blocks, and rows are judged block by block, so what
one task holds has a fixed bound.  Only built-in functions are used.

Defined results: null keys are unlisted; an empty list lists nothing; listed keys that are
not in the universe count as part of it; repeated keys count once."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curasift.llm.common import cut_lineage

#: Bits of the first level of one block (8 MB).
MAX_BITS = 1 << 26
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased): after the first ``://`` up to ``/``, ``?``, ``#`` or the end;
    path: from there up to ``?``, ``#`` or the end.  Both are empty without a ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def longest_rule(rules: Sequence[Rule], host: Column, path: Column, value: str) -> Column:
    """``value`` (text or action) of the longest rule that fits, else null; of rules equally
    long the one given first."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        out = F.when(rule.fits(host, path), F.lit(getattr(rule, value))).otherwise(out)
    return out


@dataclass(frozen=True)
class Level:
    words: Column  # array<bigint>, 64 bits each
    bits: int
    hashes: int
    number: int

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(100 * self.number + i)), F.lit(self.bits).cast("long")) for i in range(self.hashes)]

    def has(self, key: Column) -> Column:
        out = F.lit(True)
        for place in self.places(key):
            out = out & (F.getbit(F.element_at(self.words, (F.shiftright(place, 6) + 1).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1)
        return out


def _level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    hashes = max(1, round(-math.log2(rate)))
    bits = 64 * max(1, math.ceil(n * hashes / math.log(2) / 64))
    empty = Level(F.lit(None), bits, hashes, number)
    place = keys.select(F.explode(F.array(*empty.places(F.col("key")))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    rows = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("bits")).collect()  # bits / 64 rows at most
    words = [0] * (bits // 64)
    for r in rows:
        words[r.w] = r.bits
    return Level(F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>"), bits, hashes, number)


def _first_miss(levels: Sequence[Level], key: Column) -> Column:
    """Is the key listed?  By the number of the first level without it."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(level.has(key), out).otherwise(F.lit(level.number % 2 == 0))
    return out


class Cascade:
    """Exact membership of the keys of a universe in a list."""

    def __init__(self, listed: DataFrame, universe: DataFrame, rate: float = 1 / 128, later_rate: float = 1 / 8, max_bits: int = MAX_BITS):
        """Both frames have one string column; ``rate`` is the first level's, ``later_rate``
        the other levels' share of false positives."""
        key = lambda d, flag: d.select(F.col(d.columns[0]).alias("key"), F.lit(flag).alias("listed")).where("key is not null")
        keys = cut_lineage(key(universe, 0).unionByName(key(listed, 1)).groupBy("key").agg(F.max("listed").alias("listed")))
        total = keys.where("listed = 1").count()
        self.blocks = max(1, math.ceil(total * round(-math.log2(rate)) / math.log(2) / max_bits))
        self.levels = [self._build(keys.where(self.block(F.col("key")) == b), rate, later_rate) for b in range(self.blocks)]

    @staticmethod
    def _build(keys: DataFrame, rate: float, later_rate: float) -> list[Level]:
        levels: list[Level] = []
        while True:
            number = len(levels) + 1
            wanted = keys.where(F.col("listed") == number % 2)
            for level in levels:
                wanted = wanted.where(level.has(F.col("key")))
            n = wanted.count()
            if not n:
                return levels
            if number > 64:
                raise RuntimeError("the cascade does not end: different keys with equal hashes")
            levels.append(_level(wanted, n, rate if number == 1 else later_rate, number))

    def block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.blocks).cast("long"))

    def judge(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """``rows`` with a boolean column ``name``: is the key listed?"""
        parts = []
        for b, levels in enumerate(self.levels):
            part = rows if self.blocks == 1 else rows.where(F.coalesce(self.block(key), F.lit(0).cast("long")) == b)
            parts.append(part.withColumn(name, F.coalesce(key.isNotNull() & _first_miss(levels, key), F.lit(False))))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def judge_urls(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page.  The longest rule that fits
    decides; else a page is blocked if its key (host and path) is listed.  ``listed`` has one
    column of keys."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    key = F.concat("host", "path")
    cascade = Cascade(listed, split.select(key.alias("key")))
    judged = cascade.judge(split, key, "listed")
    rule, action = (longest_rule(rules, F.col("host"), F.col("path"), x) for x in ("text", "action"))
    verdict = F.coalesce(action, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")
