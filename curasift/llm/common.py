"""Helpers shared by the operators of this subpackage: bounded slices of Arrow batches,
words as numpy spans and 64-bit hashes, and reliable lineage cuts.

Words are found on the UTF-8 bytes of a whole slice at once.  Every separator used here
is an ASCII byte and no byte of a multi-byte character is ASCII, so byte classes and
character classes agree."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curasift.session import cut_lineage  # noqa: F401  (checkpoint in the session's shared folder)

#: Text bytes handled at once inside a Python task; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACES = _SPACE
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Separators of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z).
NON_ALNUM = _PUNCT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with well spread output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(which: int, n: int) -> np.ndarray:
    """The first ``n`` or more powers of one of the two odd multipliers, modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        table = np.full(size, _ODD[which], np.uint64)
        table[0] = 1
        have = _powers[which] = np.cumprod(table, dtype=np.uint64)
    return have


def release_memory() -> None:
    """Give what this worker has freed back to the machine: workers are reused, and the next
    task or stage may be another operator's."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of at most ``max_bytes`` of text (one row at least)."""
    release_memory()
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release_memory()


@dataclass
class Words:
    """Words of a slice: byte span of each word, and where each document's words begin."""

    data: np.ndarray      # uint8, all texts end to end (lower-cased if asked)
    bounds: np.ndarray    # int64, byte offset of each document, and the end
    starts: np.ndarray    # int64, first byte of each word
    ends: np.ndarray      # int64, byte after each word
    offsets: np.ndarray   # int64, index of each document's first word, and the end

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; the two functions are independent."""
        n = len(self.starts)
        if not n:
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        table = powers(which, int(lens.max()))
        begin = np.cumsum(lens) - lens
        inside = np.arange(int(lens.sum())) - np.repeat(begin, lens)
        taken = self.data[inside + np.repeat(self.starts, lens)]
        sums = np.add.reduceat((taken.astype(np.uint64) + np.uint64(1)) * table[inside], begin)
        return mix(sums + lens.astype(np.uint64) * _ODD[1 - which])

    def docs(self) -> np.ndarray:
        """The document index of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end and each text's offset; null counts as empty."""
    if pa.types.is_null(texts.type) or texts.null_count:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
    col = texts.cast(pa.large_string())
    _, off, data = col.buffers()
    bounds = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def words(texts: pa.Array, separators: np.ndarray, lower: bool) -> Words:
    """All words of all texts of the array."""
    data, bounds = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators[data]
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    begin[cuts] = inside[1:-1][cuts]
    end[cuts - 1] = inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds))


def rolling(h: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash of every ``width`` consecutive words of the slice, across documents too."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc, length, base, step, left = None, 0, h, 1, width
    p = int(_ODD[which])
    while left:
        if left & 1:
            if acc is None:
                acc, length = base, step
            else:
                m = min(len(acc), len(base) - length)
                acc = acc[:m] * np.uint64(pow(p, step, 1 << 64)) + base[length:length + m]
                length += step
        left >>= 1
        if left:
            m = len(base) - step
            base = base[:m] * np.uint64(pow(p, step, 1 << 64)) + base[step:step + m]
            step *= 2
    return mix(acc[:n])


def inside_windows(offsets: np.ndarray, width: int) -> np.ndarray:
    """Start words of all windows that lie in one document."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    begin = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(begin, counts) + np.repeat(offsets[:-1], counts)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def same_columns(docs: DataFrame, frame: DataFrame) -> DataFrame:
    """``frame`` with the columns of ``docs`` in their order."""
    return frame.select(*[f"`{c}`" for c in docs.columns])


def boxed(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and all others as one struct ``row``, so that no column of a
    user can clash with an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in keep]
    return docs.select(*keep, F.struct(*rest or [F.lit(1)]).alias("row"))


def unboxed(docs: DataFrame, frame: DataFrame, *keep: str, **changed: Column) -> DataFrame:
    """``frame`` with the columns of ``docs`` again, some of them ``changed``."""
    kept = {**{c: F.col(c) for c in keep}, **changed}
    return frame.select(*[(kept[c] if c in kept else F.col("row").getField(c)).alias(c) for c in docs.columns])


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once (as ``--py-files`` would do)."""
    sc = spark.sparkContext
    if getattr(sc, "_curasift_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="curasift-"), "curasift_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._curasift_shipped = True
