"""Benchmark decontamination with an FM-index per training shard.

Words are numbered by the benchmark's vocabulary; words outside it cannot be part of any
occurrence.  A task collects the documents of a shard (``SHARD_WORDS`` words at most, or one
document) and indexes every run of vocabulary words that is long enough to hold a test
phrase: suffix array, Burrows-Wheeler transform, a wavelet matrix over the word numbers for
rank, and every ``SAMPLE``-th suffix position.  All test phrases are searched backward
together, a word at a time; the rows of their final intervals walk back to a sampled
position, which gives the places, and the spans are merged per document.

A test phrase is ``width`` consecutive words of an item, or all words of a shorter item.
A document is contaminated if ``100 * hit words >= percent * words`` and a word is hit.

The benchmark is a stated query set: it goes to the tasks in blocks of at most
``BLOCK_BYTES`` of text, one pass over the documents for each block, so what is broadcast
has a fixed bound.  No shuffle is needed.

Defined results: null and empty texts have no words and no hits; items without words match
nothing; an item without an id counts under the empty id; several rows with one item id
count as one item; an empty benchmark leaves every document clean; rows are judged singly,
so repeated rows get equal results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curasift.llm.common import NON_ALNUM, boxed, column, inside_windows, slices, unboxed, words

#: Most words of a shard, distance of sampled suffix positions, most benchmark text in a block.
SHARD_WORDS = 500_000
SAMPLE = 16
BLOCK_BYTES = 16 << 20


@dataclass
class Phrases:
    """Distinct test phrases by length as rows of word numbers, and the items of each."""

    vocabulary: np.ndarray          # sorted word hashes; a word's number is its place plus 1
    by_length: dict[int, np.ndarray]
    items: dict[int, list[np.ndarray]]
    names: list[str]


def phrases(names: list[str], texts: list[str], width: int) -> Phrases:
    found = words(pa.array(texts, pa.large_string()), NON_ALNUM, lower=True)
    vocabulary, number = np.unique(found.hashes(), return_inverse=True)
    distinct = sorted(set(names))
    place = {x: i for i, x in enumerate(distinct)}
    item = np.array([place[x] for x in names], np.int64)
    rows: dict[int, tuple[list, list]] = {}
    n = np.diff(found.offsets)
    for length in np.unique(np.minimum(n[n > 0], width)):
        part = np.flatnonzero((n >= width) if length == width else (n == length))
        offsets = found.offsets
        starts = np.concatenate([offsets[d] + inside_windows(np.array([0, n[d]]), int(length)) for d in part])
        owner = np.concatenate([np.full(n[d] - length + 1, item[d]) for d in part])
        rows[int(length)] = (number[starts[:, None] + np.arange(length)] + 1, owner)
    by_length, items = {}, {}
    for length, (matrix, owner) in rows.items():
        by_length[length], which = np.unique(matrix, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), owner]), axis=1)
        items[length] = np.split(pairs[1], np.searchsorted(pairs[0], np.arange(1, len(by_length[length]))))
    return Phrases(vocabulary, by_length, items, distinct)


class FMIndex:
    """Index of a sequence of numbers; 0 separates runs and is never searched for."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        text = np.append(symbols, 0).astype(np.int64)
        n = len(text)
        # each separator sorts as a symbol of its own, so sorting ends at the end of a run
        gaps = np.flatnonzero(text == 0)
        rank = text + len(gaps)
        rank[gaps] = np.arange(len(gaps))
        step = 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[:n - step] = rank[step:] + 1
            key = rank * (int(rank.max()) + int(ahead.max()) + 2) + ahead
            order = np.argsort(key, kind="stable")
            new = np.r_[0, (np.diff(key[order]) != 0).astype(np.int64)]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if rank[order[-1]] == n - 1:
                break
            step *= 2
        self.suffix = order
        bwt = text[order - 1]
        self.bwt = bwt
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma + 1))]
        self.bits = max(1, int(sigma).bit_length())
        self.ones, self.zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        kept = (order % SAMPLE == 0) | (bwt == 0)
        self.sampled, self.samples = kept, order[kept]
        self.sample_rank = np.cumsum(kept) - 1

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for b in range(self.bits):
            bit = ((symbol >> (self.bits - 1 - b)) & 1).astype(bool)
            ones, zeros = self.ones[b], self.zeros[b]
            a, z = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + z, hi - z)
        return hi - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of the patterns that occur, and their row intervals."""
        which = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[which, j]
            lo, hi = (self.first[symbol] + self.rank(symbol, x) for x in (lo, hi))
            some = hi > lo
            which, lo, hi = which[some], lo[some], hi[some]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of the rows, by walking back to a sampled place."""
        out, back = np.zeros(len(rows), np.int64), 0
        open_, at = np.arange(len(rows)), rows.copy()
        while len(open_):
            here = self.sampled[at]
            out[open_[here]] = self.samples[self.sample_rank[at[here]]] + back
            open_, at = open_[~here], at[~here]
            symbol = self.bwt[at]
            at = self.first[symbol] + self.rank(symbol, at)
            back += 1
        return out


def _hits(number: np.ndarray, offsets: np.ndarray, known: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Mask of hit words, and distinct (document, item) pairs of a shard."""
    shortest = min(known.by_length, default=1)
    inside = number > 0
    begin = np.zeros(len(number) + 1, bool)
    begin[offsets] = True
    start = np.flatnonzero(inside & (begin[:-1] | ~np.r_[False, inside[:-1]]))
    end = np.flatnonzero(inside & (begin[1:] | ~np.r_[inside[1:], False])) + 1
    runs = end - start >= shortest
    start, end = start[runs], end[runs]
    edge = np.zeros(len(number) + 1, np.int64)
    pairs = [np.zeros((2, 0), np.int64)]
    if len(start):
        # runs end to end with a separator after each
        lens = end - start + 1
        place = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(start, lens)
        symbols = np.where(place < np.repeat(end, lens), number[np.minimum(place, len(number) - 1)], 0)
        index = FMIndex(symbols, len(known.vocabulary))
        for length, patterns in known.by_length.items():
            which, lo, hi = index.search(patterns)
            n = hi - lo
            rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            word = place[index.locate(rows)]
            edge += np.bincount(word, minlength=len(edge)) - np.bincount(word + length, minlength=len(edge))
            doc = np.searchsorted(offsets, word, side="right") - 1
            seen = np.unique(np.stack([doc, np.repeat(which, n)]), axis=1)
            owners = [known.items[length][p] for p in seen[1]]
            if owners:
                pairs.append(np.stack([np.repeat(seen[0], [len(x) for x in owners]), np.concatenate(owners)]))
    return np.cumsum(edge[:-1]) > 0, np.unique(np.concatenate(pairs, axis=1), axis=1)


def _scan(known) -> Callable:
    """Adds a block's findings to the columns _n, _hit (merged byte spans) and _items."""

    def shard(rows: list[pa.RecordBatch], number: list, counts: list, spans: list, p: Phrases) -> Iterator[pa.RecordBatch]:
        offsets = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int64)
        number, (first, last) = np.concatenate(number), (np.concatenate(x) for x in zip(*spans, strict=True))
        hit, pairs = _hits(number, offsets, p)
        at = 0
        for batch in rows:
            hits, items, n = [], [], []
            old_hits, old_items = column(batch, "_hit").to_pylist(), column(batch, "_items").to_pylist()
            for i in range(batch.num_rows):
                a, b = offsets[at], offsets[at + 1]
                place = np.flatnonzero(hit[a:b]).astype(np.int32)
                own = pairs[1][np.searchsorted(pairs[0], at):np.searchsorted(pairs[0], at + 1)]
                if old_hits[i] is not None and len(old_hits[i]):
                    old = np.frombuffer(old_hits[i], np.int32).reshape(3, -1)
                    place = np.union1d(place, old[0]).astype(np.int32)
                hits.append(np.stack([place, first[a:b][place], last[a:b][place]]).astype(np.int32).tobytes())
                items.append(sorted({*(old_items[i] or []), *(p.names[x] for x in own)}))
                n.append(int(b - a))
                at += 1
            for name, values in (("_n", pa.array(n, pa.int64())), ("_hit", pa.array(hits, pa.binary())), ("_items", pa.array(items, pa.list_(pa.string())))):
                batch = batch.set_column(batch.schema.get_field_index(name), name, values)
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Phrases = known.value
        held = ([], [], [], [])
        size = 0
        for batch in slices(batches):
            found = words(column(batch, "text"), NON_ALNUM, lower=True)
            h = found.hashes()
            place = np.searchsorted(p.vocabulary, h)
            place[place == len(p.vocabulary)] = 0
            number = np.where(p.vocabulary[place] == h, place + 1, 0).astype(np.int32) if len(p.vocabulary) else np.zeros(len(h), np.int32)
            base = np.repeat(found.bounds[:-1], np.diff(found.offsets))
            if size and size + len(h) > SHARD_WORDS:
                yield from shard(*held, p)
                held, size = ([], [], [], []), 0
            for x, y in zip(held, (batch, number, np.diff(found.offsets), ((found.starts - base).astype(np.int32), (found.ends - base).astype(np.int32))), strict=True):
                x.append(y)
            size += len(h)
        if held[0]:
            yield from shard(*held, p)

    return run


def _blocks(benchmark: DataFrame, width: int) -> Iterator[Phrases]:
    """The benchmark in blocks of bounded size, an empty one if it has no rows."""
    names, texts, size, any_ = [], [], 0, False
    for x in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        names.append(x.i or "")
        texts.append(x.t or "")
        size += len(texts[-1].encode()) + 64
        if size > BLOCK_BYTES:
            yield phrases(names, texts, width)
            names, texts, size, any_ = [], [], 0, True
    if names or not any_:
        yield phrases(names, texts, width)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """``docs`` with _n (words), _hit (int32 rows: word, first byte, byte after) and _items."""
    out = docs.withColumns({"_n": F.lit(0).cast("long"), "_hit": F.lit(None).cast("binary"), "_items": F.lit(None).cast("array<string>")})
    for block in _blocks(benchmark, width):
        out = out.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(block)), _nullable(out.schema))
    return out


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def _n_hit() -> F.Column:
    return F.coalesce(F.octet_length("_hit"), F.lit(0)).cast("long") / 12


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, percent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined),
    contaminated, items."""
    out = scan(docs.select("doc_id", "text"), benchmark, width)
    hit, items = _n_hit().cast("long"), F.coalesce("_items", F.array().cast("array<string>"))
    return out.select("doc_id", F.col("_n").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((hit > 0) & (100 * hit >= percent * F.col("_n"))).alias("contaminated"), items.alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, percent: int = 5) -> DataFrame:
    """The rows and columns of ``docs`` without contaminated documents; from the others the
    merged hit spans are cut (with the space before them), and ``n_chars`` follows."""
    out = scan(boxed(docs, "text"), benchmark, width)
    hit = _n_hit().cast("long")
    out = out.where(~((hit > 0) & (100 * hit >= percent * F.col("_n"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = []
            for t, h in zip(column(batch, "text"), column(batch, "_hit").to_pylist(), strict=True):
                text.append(t.as_py() if not h or not t.is_valid else _cut(t.as_buffer().to_pybytes(), np.frombuffer(h, np.int32).reshape(3, -1)))
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(text, pa.string()))

    cut = out.mapInArrow(run, _nullable(out.schema))
    changed = {}
    if "n_chars" in docs.columns:
        before = F.col("row").getField("n_chars")
        changed["n_chars"] = F.when(F.octet_length("_hit") > 0, F.length("text")).otherwise(before).cast(docs.schema["n_chars"].dataType)
    return unboxed(docs, cut, "text", **changed)


def _cut(text: bytes, hits: np.ndarray) -> str:
    """The text without its hit words; consecutive ones go with what stands between them."""
    groups = np.split(hits, np.flatnonzero(np.diff(hits[0]) > 1) + 1, axis=1)
    out, at = [], 0
    for g in groups:
        out.append(text[at:g[1, 0]].rstrip(b" "))
        at = int(g[2, -1])
    return b"".join([*out, text[at:]]).decode()
