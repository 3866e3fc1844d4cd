"""Runs (maximal repetitions) of words, from the suffix trees of a text and of its reversal.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and
``exponent * q`` words long, that no neighbouring word extends.

1. *Words that can't be in a run go.*  In a run each word occurs ``exponent`` times or more, so
   a word that occurs less often in its stretch parts the text, and so on until no stretch
   changes.  Nothing of a run is lost, and what is left of ordinary prose is short.
2. *Longest common extensions.*  Ukkonen's algorithm makes the suffix tree of a stretch and that
   of its reversal in linear time.  The lowest common ancestor of two leaves is the least
   depth between them in the Euler tour, found in constant time from the minima of blocks of
   the tour; its depth is the length of the words that two places share to the right (to the left, in
   the reversal).
3. *Candidates.*  At each place the longest Lyndon word for the order of the words, and for the
   opposite order, is a candidate for a run's root; it ends where the next smaller suffix
   begins.  Every run has such a root.  Extending each root to both sides gives all runs.

Defined results: null and empty texts have no words and no runs; a text's result depends on
that text alone, so repeated rows have equal results; an empty table gives an empty result.  A
text is handled whole in one task: memory is some hundred times its bytes while it consists
of repetitions only, far less otherwise.  Only the columns doc_id and text are read by ``run_report``;
``drop_repetitions`` returns the columns of its input."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curasift.llm.common import column, slices

#: Least exponent (length / period) and least length of a run in words.
EXPONENT, LEAST = 4, 6
#: Entries of the Euler tour in a block.
TOUR_BLOCK = 32

Run = tuple[int, int, int]


class SuffixTree:
    """Ukkonen's suffix tree of ``symbols`` (integers from 0) and an end symbol below them all."""

    def __init__(self, symbols: list[int]):
        text = [*(x + 1 for x in symbols), 0]
        n, k = len(text), max(text) + 1
        # node 0 is the root; an edge is known by its lower node; leaves end at n
        start, end, link, kids = [0], [0], [0], {}
        node, edge, length, left = 0, 0, 0, 0
        for i, symbol in enumerate(text):
            left += 1
            inner = 0  # the inner node made last, which still lacks its link
            while left:
                if not length:
                    edge = i
                slot = node * k + text[edge]
                child = kids.get(slot)
                if child is None:
                    kids[slot] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if inner:
                        link[inner] = node
                        inner = 0
                else:
                    span = end[child] if end[child] < i + 1 else i + 1
                    span -= start[child]
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    at = start[child]
                    if text[at + length] == symbol:
                        length += 1
                        if inner:
                            link[inner] = node
                        break
                    new = len(start)
                    start += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    kids[slot] = new
                    kids[new * k + symbol] = new + 1
                    start[child] = at + length
                    kids[new * k + text[at + length]] = child
                    if inner:
                        link[inner] = new
                    inner = new
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self.n = n - 1
        self._tour(n, k, start, end, kids)

    def _tour(self, n: int, k: int, start: list[int], end: list[int], kids: dict[int, int]) -> None:
        """The Euler tour, by ranking the linked list of its steps: step x enters node x, step
        m + x goes back from x to its parent."""
        m = len(start)
        slots = np.fromiter(kids.keys(), np.int64, m - 1)
        order = np.argsort(slots)
        child = np.fromiter(kids.values(), np.int64, m - 1)[order]
        parent = slots[order] // k
        head = np.r_[True, parent[1:] != parent[:-1]]
        last = np.r_[head[1:], True]
        after = np.empty(2 * m, np.int64)
        after[:m] = np.arange(m, 2 * m)  # a leaf is left at once
        after[parent[head]] = child[head]
        after[m + child[:-1]] = child[1:]
        after[m + child[last]] = m + parent[last]
        after[m] = m  # the end: back from the root
        ahead = np.ones(2 * m, np.int64)
        ahead[m] = 0
        for _ in range((2 * m).bit_length()):
            ahead += ahead[after]
            after = after[after]
        at = ahead[0] - ahead  # the place of each step in the tour
        steps = np.zeros(2 * m, np.int32)
        size = np.asarray(end, np.int32) - np.asarray(start, np.int32)
        size[0] = 0
        steps[at[:m]] = size
        steps[at[m + child]] = -size[child]
        depth = np.cumsum(steps[:-1], dtype=np.int32)
        leaf = np.ones(m, bool)
        leaf[parent] = False
        leaves = np.flatnonzero(leaf)
        suffix = n - depth[at[leaves]]
        self.place = np.empty(n, np.int64)
        self.place[suffix] = at[leaves]
        # if the end symbol is the largest, the child by it comes when its parent is left
        late = self.place.copy()
        by_end = np.flatnonzero(slots[order] % k == 0)
        late[n - depth[at[child[by_end]]]] = at[m + child[last]][np.cumsum(head)[by_end] - 1]
        self.place = self.place[:-1] if n > 1 else self.place
        #: Order of the suffixes if the end symbol is the smallest, and if it is the largest.
        self.rank, self.late = self.place.tolist(), late[:n - 1].tolist()
        self._minima(depth)

    def _minima(self, tour: np.ndarray) -> None:
        b = TOUR_BLOCK
        self.tour = np.concatenate([tour, np.full(-len(tour) % b, np.iinfo(np.int32).max, np.int32)])
        blocks = self.tour.reshape(-1, b)
        self.to = np.minimum.accumulate(blocks, axis=1).ravel()
        self.since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        step = 1
        while 2 * step <= len(blocks):
            last = self.table[-1]
            self.table.append(np.minimum(last[:len(last) - step], last[step:]))
            step *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``i`` and ``j`` (different places) share."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        x, y = a // TOUR_BLOCK, b // TOUR_BLOCK
        out = np.minimum(self.since[a], self.to[b])
        far = np.flatnonzero(y - x > 1)
        if len(far):
            width = y[far] - x[far] - 1
            level = np.frexp(width.astype(np.float64))[1] - 1
            for k in np.unique(level):
                own = level == k
                at, w, row = far[own], width[own], self.table[k]
                out[at] = np.minimum(out[at], np.minimum(row[x[at] + 1], row[x[at] + 1 + w - (1 << int(k))]))
        near = np.flatnonzero(x == y)
        if len(near):
            lo, hi, least = a[near], b[near], self.tour[a[near]]
            for k in range(1, TOUR_BLOCK):
                least = np.minimum(least, self.tour[np.minimum(lo + k, hi)])
            out[near] = least
        return out


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next place with a smaller rank, or the end."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.asarray(out, np.int64)


def all_runs(symbols: list[int]) -> np.ndarray:
    """All runs of exponent 2 or more as rows (start, length, period), sorted."""
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    right, left = SuffixTree(symbols), SuffixTree(symbols[::-1])
    places = np.arange(n)
    found = []
    for ends in (_next_smaller(right.rank), _next_smaller([-r for r in right.late])):
        i = np.flatnonzero(ends < n)
        p = ends[i] - places[i]
        after = right.common(i, i + p)
        before = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        before[inner] = left.common(n - i[inner], n - i[inner] - p[inner])
        long = before + after >= p
        found.append(np.stack([i - before, before + p + after, p], axis=1)[long])
    return np.unique(np.concatenate(found), axis=0)


def _stretches(codes: np.ndarray, least_count: int, least: int) -> list[tuple[int, int]]:
    """The stretches (start, end) in which every word occurs often enough to be in a run."""
    stretch = np.zeros(len(codes), np.int64)
    places = np.arange(len(codes))
    while len(codes):
        _, which, count = np.unique(stretch * (int(codes.max()) + 1) + codes, return_inverse=True, return_counts=True)
        keep = count[which] >= least_count
        part = np.cumsum(np.r_[True, (np.diff(places) > 1) | (np.diff(stretch) > 0)])
        part = (part + np.cumsum(~keep))[keep]
        places, codes = places[keep], codes[keep]
        if not len(part):
            return []
        _, stretch, size = np.unique(part, return_inverse=True, return_counts=True)
        enough = size[stretch] >= least
        if keep.all() and enough.all():
            cut = np.flatnonzero(np.r_[True, np.diff(stretch) > 0, True])
            return [(int(places[a]), int(places[b - 1]) + 1) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        places, codes, stretch = places[enough], codes[enough], stretch[enough]
    return []


def runs_of(words: list[bytes], exponent: int = EXPONENT, least: int = LEAST) -> list[Run]:
    """The runs (start, length, period) of a text's words, by start and period."""
    if len(words) < max(least, exponent):
        return []
    number: dict[bytes, int] = {}
    codes = np.asarray([number.setdefault(w, len(number)) for w in words], np.int64)
    out = []
    for a, b in _stretches(codes, exponent, max(least, exponent)):
        symbols = np.unique(codes[a:b], return_inverse=True)[1].tolist()
        for start, length, period in all_runs(symbols).tolist():
            if length >= max(least, exponent * period):
                out.append((a + start, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, x in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not x]


def _words(text: pa.Scalar) -> list[bytes]:
    # bytes.split() parts at 0x20 and 0x09 to 0x0D
    return text.as_buffer().to_pybytes().split() if text.is_valid else []


def run_report(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """Per row: doc_id, n_runs; start, length, period and exponent_milli of the run with the
    greatest length / period (ties: the first); runs_sha256 and collapsed_sha256; runs (start,
    length, period).  ``prepare`` may give other words for a row's id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for key, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text"), strict=True):
                words = _words(text)
                if prepare is not None:
                    words = prepare(key, words)
                runs = runs_of(words, exponent, least)
                best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
                milli = 1000 * best[1] // best[2] if runs else None
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
                out.append((key, len(runs), *best, milli, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest(),
                            [{"start": s, "length": n, "period": p} for s, n, p in runs]))
            names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs")
            spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            kinds = (*[pa.int64()] * 6, pa.string(), pa.string(), spans)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def drop_repetitions(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """The rows and columns of ``docs``; texts with runs become their kept words joined by one
    space, other texts stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text in column(batch, "text"):
                words = _words(text)
                runs = runs_of(words, exponent, least)
                texts.append(b" ".join(kept_words(words, runs)).decode() if runs else text.as_py())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
