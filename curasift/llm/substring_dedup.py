"""Substring deduplication with a count-min prefilter.

A window is ``width`` consecutive words of one document.  Words covered by a window whose
word sequence also starts in a document with a smaller id are removed.

1. *Sketch.*  A window is stood for by the gram of ``width // 2`` words with the smallest
   hash among those it contains.  Equal windows have equal grams, so the count of the gram
   is never below the count of the window, and neighbouring windows share a gram, so only
   about one gram in fourteen words is counted.  Every partition counts its grams into a
   two-row count-min sketch of fixed size, sent as sparse slices and summed per slice.
2. *Exact pass.*  Only windows whose gram is estimated to occur twice or more are emitted,
   as 128-bit hashes.  Each task first settles what its own documents settle (a window that
   one of its documents with a smaller id has is marked at once), so a passage that a third
   of all documents share sends one row per task.  A grouping over the hashes then finds
   the smallest document id of each window.  A too small sketch only lets more windows
   through; none is lost.

What is sent to all executors is one bit per cell (``2 * cells / 8`` bytes, 16 MB by
default), whatever the size of the input.

Defined results: null text counts as empty; rows without an id keep their text and remove
nothing from others; repeated rows are judged alike, each by its id and text; an empty
table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curasift.llm.common import SPACES, boxed, column, inside_windows, mix, rolling, signed, slices, unboxed, words

#: Cells of each of the two rows of the sketch, and of each slice in which it travels.
CELLS = 1 << 26
SLICE_CELLS = 1 << 20
#: Entries held in a task before they are sent on.
FLUSH = 1_000_000
_SALT = np.uint64(0xA0761D6478BD642F)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def _window_grams(h: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and gram hash of each window."""
    starts = inside_windows(offsets, width)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    gram = max(1, width // 2)
    return starts, _sliding_min(rolling(h, gram), width - gram + 1)[starts]


def _cells(gram: np.ndarray, row: int, cells: int) -> np.ndarray:
    x = mix(gram + _SALT) if row else gram >> np.uint64(20)
    return (x & np.uint64(cells - 1)).astype(np.int64)


def _count(width: int, cells: int) -> Callable:
    def sent(grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gram = np.concatenate(grams)
        for row in (0, 1):
            cell, n = np.unique(_cells(gram, row, cells), return_counts=True)
            cut = np.flatnonzero(np.diff(cell // SLICE_CELLS, prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(cell)], strict=True):
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array([row], pa.int32()), "part": pa.array([cell[a] // SLICE_CELLS], pa.int32()),
                    "cells": pa.array([(cell[a:b] % SLICE_CELLS).astype(np.uint32).tobytes()], pa.binary()),
                    "counts": pa.array([np.minimum(n[a:b], 255).astype(np.uint8).tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches):
            found = words(column(batch, "text"), SPACES, lower=False)
            starts, gram = _window_grams(found.hashes(), found.offsets, width)
            if not len(gram):
                continue
            # neighbouring windows of a document share their gram; it is counted once
            doc = np.searchsorted(found.offsets, starts, side="right")
            new = np.r_[True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])]
            held.append(gram[new])
            n += len(held[-1])
            if n >= FLUSH:
                yield from sent(held)
                held, n = [], 0
        if held:
            yield from sent(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the partitions' slices (sorted by slice): which cells reach a count of two."""
    key, total = None, np.zeros(SLICE_CELLS, np.uint8)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"row": pa.array([key[0]], pa.int32()), "part": pa.array([key[1]], pa.int32()), "bits": pa.array([np.packbits(total >= 2).tobytes()], pa.binary())})

    for batch in batches:
        for row, part, cell, n in zip(*(column(batch, c).to_pylist() for c in ("row", "part", "cells", "counts")), strict=True):
            if key != (row, part):
                if key is not None:
                    yield out()
                key = (row, part)
                total[:] = 0
            at = np.frombuffer(cell, np.uint32)
            total[at] = np.minimum(total[at].astype(np.uint16) + np.frombuffer(n, np.uint8), 255).astype(np.uint8)
    if key is not None:
        yield out()


def sketch(docs: DataFrame, width: int = 50, cells: int = CELLS) -> np.ndarray:
    """One bit per cell and row of the merged sketch: is the count two or more?"""
    sent = docs.select("text").mapInArrow(_count(width, cells), "row int, part int, cells binary, counts binary")
    merged = sent.repartition("row", "part").sortWithinPartitions("row", "part").mapInArrow(_merge, "row int, part int, bits binary")
    bits = np.zeros((2, cells // 8), np.uint8)
    for x in merged.toLocalIterator():  # bounded by the size of the sketch
        bits[x.row, x.part * SLICE_CELLS // 8:(x.part + 1) * SLICE_CELLS // 8] = np.frombuffer(x.bits, np.uint8)[:max(0, cells // 8 - x.part * SLICE_CELLS // 8)]
    return bits


def _candidates(width: int, cells: int, shared) -> Callable:
    """Windows estimated to be repeated; those that the task itself settles come as ``done``."""

    def sent(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        w1, w2, doc, key, start = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, w2, w1))
        w1, w2, doc, key, start = (x[order] for x in (w1, w2, doc, key, start))
        new = np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        settled = doc > least
        yield from batches_of(w1[~settled], w2[~settled], doc[~settled], key[~settled], start[~settled], None)
        d, k, s = doc[settled], key[settled], start[settled]
        if len(d):
            order = np.lexsort((s, k, d))
            d, k, s = d[order], k[order], s[order].astype(np.int32)
            cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])])
            packed = [s[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(d)], strict=True)]
            own = mix(d[cut].astype(np.uint64) ^ k[cut].astype(np.uint64))
            yield from batches_of(own, own, d[cut], k[cut], np.full(len(cut), -1), packed)

    def batches_of(w1, w2, doc, key, start, packed) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(w1), 50_000):
            b = a + 50_000
            yield pa.RecordBatch.from_pydict({
                "w1": pa.array(signed(w1[a:b])), "w2": pa.array(signed(w2[a:b])), "doc_id": pa.array(doc[a:b]), "text_key": pa.array(key[a:b]),
                "start": pa.array(start[a:b].astype(np.int32)), "done": pa.array(packed[a:b], pa.binary()) if packed is not None else pa.nulls(len(w1[a:b]), pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, n = shared.value, [], 0
        for batch in slices(batches):
            found = words(column(batch, "text"), SPACES, lower=False)
            h = found.hashes()
            starts, gram = _window_grams(h, found.offsets, width)
            if not len(gram):
                continue
            often = np.ones(len(gram), bool)
            for row in (0, 1):
                cell = _cells(gram, row, cells)
                often &= (bits[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
            starts = starts[often]
            if not len(starts):
                continue
            at = np.searchsorted(found.offsets, starts, side="right") - 1
            ids = column(batch, "doc_id").to_numpy(zero_copy_only=False)
            keys = column(batch, "text_key").to_numpy(zero_copy_only=False)
            held.append((rolling(h, width)[starts], rolling(mix(h + _SALT), width, 1)[starts], ids[at].astype(np.int64), keys[at].astype(np.int64), starts - found.offsets[at]))
            n += len(starts)
            if n >= FLUSH:
                yield from sent(held)
                held, n = [], 0
        if held:
            yield from sent(held)

    return run


def repeats(docs: DataFrame, width: int = 50, cells: int = CELLS) -> DataFrame:
    """doc_id, text_key (hash of the text), starts, packed: the first words of all windows
    that a document with a smaller id has too; ``packed`` holds int32 arrays."""
    if width < 2:
        raise ValueError("a window has two words at least")
    cells = max(SLICE_CELLS, 1 << (cells - 1).bit_length())
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    shared = docs.sparkSession.sparkContext.broadcast(sketch(keyed, width, cells))
    found = keyed.where("doc_id is not null").mapInArrow(_candidates(width, cells, shared), "w1 long, w2 long, doc_id long, text_key long, start int, done binary")
    least = F.min("doc_id").over(Window.partitionBy("w1", "w2"))
    again = found.withColumn("least", least).where("done is not null or doc_id > least")
    return again.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.when(F.col("done").isNull(), F.col("start"))).alias("starts"), F.collect_list("done").alias("packed"))


def _covered(n: int, width: int, starts, packed) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    for s in [np.asarray(starts, np.int32), *(np.frombuffer(x, np.int32) for x in packed)]:
        edge[np.unique(s)] += 1
        np.subtract.at(edge, np.minimum(np.unique(s) + width, n), 1)
    return np.cumsum(edge[:-1]) > 0


def _each(batch: pa.RecordBatch, width: int) -> Iterator[tuple[list[bytes], np.ndarray | None]]:
    """Words and removal mask (None: nothing to remove) of each row."""
    for text, starts, packed in zip(column(batch, "text"), column(batch, "_starts"), column(batch, "_packed"), strict=True):
        found = text.as_buffer().to_pybytes().split() if text.is_valid else []
        if not starts.is_valid:
            yield found, None
        else:
            yield found, _covered(len(found), width, starts.values.to_numpy(zero_copy_only=False) if starts.values is not None else [], packed.as_py() or [])


def _joined(docs: DataFrame, width: int, cells: int) -> DataFrame:
    marks = repeats(docs, width, cells).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("starts").alias("_starts"), F.col("packed").alias("_packed"))
    return docs.withColumn("_text_key", F.xxhash64("text")).join(marks, (F.col("doc_id") == F.col("_doc")) & (F.col("_text_key") == F.col("_key")), "left").drop("_doc", "_key", "_text_key")


def removal_report(docs: DataFrame, width: int = 50, cells: int = CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, gone, sha = [], [], []
            for found, out in _each(batch, width):
                kept = found if out is None else [w for w, x in zip(found, out, strict=True) if not x]
                total.append(len(found))
                gone.append(len(found) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return _joined(docs.select("doc_id", "text"), width, cells).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = 50, cells: int = CELLS) -> DataFrame:
    """The rows and columns of ``docs``; texts that lose words become their kept words joined
    by one space (``n_chars``, if there, follows), other texts stay as they are."""
    joined = _joined(boxed(docs, "doc_id", "text"), width, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = []
            for i, (found, out) in enumerate(_each(batch, width)):
                text.append(column(batch, "text")[i].as_py() if out is None else b" ".join(w for w, x in zip(found, out, strict=True) if not x).decode())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(text, pa.string()))

    cut = joined.mapInArrow(run, joined.schema)
    changed = {}
    if "n_chars" in docs.columns:
        before = F.col("row").getField("n_chars")
        changed["n_chars"] = F.when(F.col("_starts").isNotNull(), F.length("text")).otherwise(before).cast(docs.schema["n_chars"].dataType)
    return unboxed(docs, cut, "doc_id", "text", **changed)
