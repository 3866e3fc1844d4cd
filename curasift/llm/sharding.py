"""Sharding by sampled splitters, into shards of near equal bytes.

Records are ordered by the hash of their text, then by id, then by a hash of their row number, so
equal texts are neighbours and even equal rows can be told apart.

1. A size-weighted sample of the records (each with a probability in proportion to its size)
   gives quantile splitters, which cut the key order into many ranges of about equal bytes.
   These first splitters lie between texts, so a group of equal texts starts in one range.
2. Exact bytes of each range are counted.  An overfull range (twice its share) is subdivided: its
   records are sampled anew, a record larger than a share gets a range of its own, and a group of
   equal texts that is itself too large is split by id and row.  This repeats until no range of
   several records is overfull; every round cuts every such range.
3. Consecutive ranges go to shards by their cumulative bytes; then single ranges move from the
   fullest to the emptiest shard while that evens them out.  A record's slot is the count of
   records in earlier ranges of its shard plus its place in its own range.

Only range statistics (their number depends on the shard count and on ``rows / ROWS``) and
the bounded samples reach the driver.  The texts are read once, and nothing but key, id, size
and checksum is shuffled.  Only built-in functions are used.

Defined results: null text has size 1 and checksum 0; rows without an id come first among
equal texts; which of several equal rows goes to which shard depends on the order in which they
are read; with no rows the result is empty."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curasift.llm.common import cut_lineage

#: Ranges for each shard, most records of a range on average, samples for each range.
RANGES, ROWS, SAMPLES = 64, 1_000_000, 32
_LEAST = -(1 << 63)
Key = tuple[int, int, int]  # hash of the text, id, hash of the row number


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _first(h: int) -> Key:
    """The least key of a text."""
    return h, _LEAST, _LEAST


def _key_columns() -> list[Column]:
    return [F.xxhash64("text").alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("d"), F.xxhash64(F.monotonically_increasing_id()).alias("t")]


def _not_after(splitter: Sequence[Column]) -> Column:
    """Is the splitter at or before the record's key?"""
    (h, d, t), (x, y, z) = splitter, (F.col(c) for c in "hdt")
    return (h < x) | ((h == x) & ((d < y) | ((d == y) & (t <= z))))


def _range_of(splitters: list[Key]) -> Column:
    """How many splitters are at or before the record's key, by bisection."""
    if not splitters:
        return F.lit(0)
    parts = [_numbers(list(x)) for x in zip(*splitters, strict=True)]
    steps = [1 << b for b in range(len(splitters).bit_length() - 1, -1, -1)]
    before = lambda k: _not_after([x[k] for x in parts])
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda i, s: F.when((i + s <= len(splitters)) & F.when(i + s <= len(splitters), before(i + s - 1)), i + s).otherwise(i))


def _after(h: int, d: int) -> Key:
    """The least key after all rows of a text and id."""
    return (h, d + 1, _LEAST) if d < (1 << 63) - 1 else _first(h + 1)


def _uniform(*parts: str | Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def _sample(records: DataFrame, share: Column, seed: int) -> list[tuple[int, int]]:
    """Text and id of records drawn with a probability of ``size * share``; equal rows count once."""
    drawn = records.where(_uniform("h", "d", "text_crc32", F.lit(seed)) < F.col("size") * share)
    return sorted((x.h, x.d) for x in drawn.select("h", "d").distinct().collect())


def _repeated(records: DataFrame, share: Column, seed: int) -> list[tuple[int, int]]:
    """Text and id of groups of equal rows that take up some half of a range; here each row is drawn by itself."""
    drawn = records.where(_uniform("h", "d", "t", F.lit(seed)) < F.col("size") * share).groupBy("h", "d").agg(F.count(F.lit(1)).alias("n"))
    return sorted((x.h, x.d) for x in drawn.where(F.col("n") >= SAMPLES // 2).collect())


def _cuts_of(lo: Key, hi: Key, size: int, top: Key, parts: int, drawn: list[tuple[int, int]], repeated: list[tuple[int, int]]) -> set[Key]:
    """Cuts after ``lo`` and up to ``hi``, one at least, for an overfull range of ``parts`` shares whose largest
    record (``top``) has ``size`` shares."""
    if lo[:2] == hi[:2]:  # equal rows: their hashes are uniform
        cuts = {(*lo[:2], lo[2] + (hi[2] - lo[2]) * i // parts) for i in range(1, parts)}
        return {c for c in cuts if lo < c <= hi} or {hi}
    drawn = drawn[bisect_left(drawn, lo[:2]):bisect_right(drawn, hi[:2])]
    groups: dict[int, int] = {}
    for h, _ in drawn:
        groups[h] = groups.get(h, 0) + 1
    cuts = set()
    for h, d in drawn[SAMPLES // 2::SAMPLES]:
        cuts |= {_first(h)} if groups[h] < SAMPLES else {_first(h), (h, d, _LEAST)}  # equal texts stay in one range that can hold them
    cuts |= {_first(h + 1) for h, n in groups.items() if n >= SAMPLES and h < (1 << 63) - 1}  # a large group ends where the next text begins
    for h, d in repeated[bisect_left(repeated, lo[:2]):bisect_right(repeated, hi[:2])] + ([top[:2]] if size else []):
        cuts |= {(h, d, _LEAST), _after(h, d)}
    cuts = {c for c in cuts if lo < c <= hi}
    if not cuts:
        later = [k for k in drawn if k > lo[:2]] or [hi[:2]]
        h, d = later[len(later) // 2]
        cuts = {_first(h) if _first(h) > lo else (h, d, _LEAST)}
    return cuts


def _splitters(records: DataFrame, total: int, n_ranges: int) -> list[Key]:
    target = total / n_ranges
    cuts = {_first(h) for h, _ in _sample(records, F.lit(n_ranges * SAMPLES / total), 1)[SAMPLES // 2::SAMPLES]}
    key, round_ = F.struct("h", "d", "t"), 1
    while True:
        stats = records.groupBy(_range_of(sorted(cuts)).alias("r")).agg(F.sum("size").alias("bytes"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.max(F.struct("size", "h", "d", "t")).alias("top")).collect()
        full = sorted((tuple(x.lo), tuple(x.hi), x.bytes, tuple(x.top)) for x in stats if x.bytes > 2 * target and x.lo != x.hi)
        if not full:
            return sorted(cuts)
        round_ += 1
        ends = [_numbers(list(x)) for x in zip(*[hi for _, hi, _, _ in full], strict=True)]
        inside = records.withColumn("f", _range_of([lo for lo, _, _, _ in full]) - 1).where("f >= 0")
        inside = inside.where(key <= F.struct(*[x[F.col("f")].alias(c) for x, c in zip(ends, "hdt", strict=True)]))
        drawn, repeated = (draw(inside, F.lit(SAMPLES / target), round_) for draw in (_sample, _repeated))
        for lo, hi, size, (largest, *top) in full:
            cuts |= _cuts_of(lo, hi, int(largest / target), tuple(top), math.ceil(size / target), drawn, repeated)


def _balanced(sizes: list[int], shards: int) -> list[int]:
    """A shard for each range, consecutive but for the moves that even the shards out."""
    ends, total, chosen, filled = [s * sum(sizes) / shards for s in range(1, shards)], 0, [], [0] * shards
    for size in sizes:
        chosen.append(bisect_right(ends, total + size / 2))
        total += size
        filled[chosen[-1]] += size
    for _ in range(16 * shards):
        most, least = filled.index(max(filled)), filled.index(min(filled))
        gap = filled[most] - filled[least]
        own = [i for i, s in enumerate(chosen) if s == most and 0 < sizes[i] < gap]
        if not own:
            break
        i = min(own, key=lambda i: abs(sizes[i] - gap / 2))
        chosen[i] = least
        filled[most] -= sizes[i]
        filled[least] += sizes[i]
    return chosen


def _placed(docs: DataFrame, shards: int) -> tuple[DataFrame, list[Key], list[int], list[int]]:
    """The records with their range ``r``; the splitters; of each range its shard and the records
    before it in the shard."""
    records = cut_lineage(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0).cast("long")).alias("text_crc32"), *_key_columns()))
    whole = records.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n_ranges = max(min(RANGES * shards, 4 * shards + whole.n // 4), math.ceil(whole.n / ROWS))
    splitters = _splitters(records, whole.bytes, n_ranges) if whole.n else []
    placed = records.withColumn("r", _range_of(splitters))
    stats = sorted(placed.groupBy("r").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect())
    chosen = _balanced([x.bytes for x in stats], shards)
    shard_of, offset_of, filled = [0] * (len(splitters) + 1), [0] * (len(splitters) + 1), [0] * shards
    for (r, _, n), shard in zip(stats, chosen, strict=True):
        shard_of[r], offset_of[r] = shard, filled[shard]
        filled[shard] += n
    return placed, splitters, shard_of, offset_of


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    placed, _, shard_of, offset_of = _placed(docs, shards)
    place = F.row_number().over(Window.partitionBy("r").orderBy("h", "d", "t"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), _numbers(shard_of)[F.col("r")].cast("int").alias("shard"),
                         (_numbers(offset_of)[F.col("r")] + place - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write the rows of ``docs`` to one folder per shard (``shard=0`` and so on; if ``docs`` has a
    column ``shard``, ``shard_=0``).  Each row is placed by its own key, without a join; equal rows
    of a group that was split are dealt by hash over its ranges."""
    _, splitters, shard_of, _ = _placed(docs, shards)
    name = "shard"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key_columns())
    shard = _numbers(shard_of)[_range_of(splitters)].cast("int")
    keyed.select("row.*", shard.alias(name)).write.partitionBy(name).parquet(path)
