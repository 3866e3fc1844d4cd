"""Near duplicates by circulant MinHash (two permutations) and exact Jaccard verification.

Method: a shingle hashes to a position (the first permutation); the second permutation is
one table over ``1 << DOMAIN_BITS`` positions, and coordinate k of a signature is the
smallest table entry ``k`` places on from the document's positions.  All coordinates of a
shingle are thus one contiguous run of the table.  ``bands`` bands of ``rows`` coordinates
give buckets.  With 32 bands of 5, a pair at a similarity of exactly 0.8 shares no bucket
with probability 3e-6, one at 0.85 with 7e-9.

Copies are folded first: documents with equal shingle sets (128-bit fingerprint and size)
form a class, and only class representatives (smallest id) get buckets.  In a bucket each
member is compared with the bucket's leader, not with all others.  Where the members of a
bucket then still lie in several components, a second pass compares all pairs across these
components; pairs within a component can add nothing.  Such a bucket's members are gathered
once (buckets with equal members count once) in blocks of ``BLOCK``, block against block; a
pair is compared in the first bucket it shares, and only links are sent on.  So no link
between different texts is lost for want of comparing, and no list of pairs is ever made.

Comparisons are by full shingle sets, streamed per leader (members split over salted
partitions).  Components are found by contraction rounds over the links, as joins with
checkpoints; nothing about documents goes to the driver but two counts a round.

Defined results: null and empty texts have empty sets and no links; a document with fewer
words than a shingle has its whole word sequence as one shingle; rows without an id have a
null component and are kept; repeated rows get the same component."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curasift.llm.common import SLICE_BYTES, SPACES, Words, boxed, column, cut_lineage, mix, signed, slices, unboxed, words

DOMAIN_BITS = 22
#: Members of a leader compared in one partition group.
MEMBERS_PER_TASK = 512
#: Members of an open bucket in a block, and shingles compared at once.
BLOCK, AT_ONCE = 2048, 1 << 20
_SHORT = np.uint64(0xE7037ED1A0B428DB)
_STEP = np.uint64(0x8EBC6AF09C88C6E3)
_table: dict[tuple[int, int], np.ndarray] = {}


def _second_permutation(length: int, seed: int = 7) -> np.ndarray:
    """The table, continued by its own beginning, as overlapping runs of ``length`` entries."""
    key = (length, seed)
    if key not in _table:
        perm = np.random.default_rng(seed).permutation(1 << DOMAIN_BITS).astype(np.int32)
        _table[key] = np.lib.stride_tricks.sliding_window_view(np.r_[perm, perm[:length]], length)
    return _table[key]


def _shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a slice, and each document's first one."""
    h = found.hashes()
    n = np.diff(found.offsets)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    acc = h.copy()
    for j in range(1, size):
        m = max(0, len(h) - j)
        acc[:m] = mix(acc[:m] * _STEP + h[j:])
    offsets = np.r_[0, np.cumsum(counts)]
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts) + np.repeat(found.offsets[:-1], counts)
    out = acc[at]
    for d in np.flatnonzero((n > 0) & (n < size)):
        value = _SHORT
        for x in h[found.offsets[d]:found.offsets[d + 1]]:
            value = mix(np.array([value * _STEP + x]))[0]
        out[offsets[d]] = value
    return out, offsets


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    with np.errstate(over="ignore"):
        all_, offsets = _shingles(words(texts, SPACES, lower=True), size)
    return [np.unique(all_[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def signature(shingles: np.ndarray, length: int) -> np.ndarray:
    table = _second_permutation(length)
    at = (shingles >> np.uint64(64 - DOMAIN_BITS)).astype(np.int64)
    out = np.full(length, np.iinfo(np.int32).max, np.int32)
    for a in range(0, len(at), 4096):
        np.minimum(out, table[at[a:a + 4096]].min(axis=0), out=out)
    return out


def _features(size: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(column(batch, "text"), size)
            sig = np.stack([signature(s, bands * rows) for s in sets]).reshape(len(sets), bands, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands)).copy()
            for j in range(rows):
                key = mix(key * _STEP + sig[:, :, j] + np.uint64(1))
            n = np.array([len(s) for s in sets])
            s1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            s2 = np.array([mix(s ^ _SHORT).sum(dtype=np.uint64) for s in sets], np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(signed(key.ravel())))
            yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id"), "n_shingles": pa.array(n, pa.int64()), "s1": pa.array(signed(s1)), "s2": pa.array(signed(s2)), "buckets": lists})

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text compressed; texts are shuffled so."""
    for batch in slices(batches):
        texts = column(batch, "text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id"), "text": pa.array([None if t is None else zlib.compress(t, 1) for t in texts], pa.binary())})


def _unpacked(batches: Iterator[pa.RecordBatch], max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows with their texts as they were, in batches of at most ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        start, held, size = 0, [], 0
        for packed in batch.column(at):
            text = None if not packed.is_valid else zlib.decompress(packed.as_py())
            n = len(text or b"")
            if held and size + n > max_bytes:
                yield batch.slice(start, len(held)).set_column(at, "text", pa.array(held, pa.binary()).cast(pa.string()))
                start, held, size = start + len(held), [], 0
            held.append(text)
            size += n
        if held:
            yield batch.slice(start, len(held)).set_column(at, "text", pa.array(held, pa.binary()).cast(pa.string()))


def _compare(size: int, percent: int) -> Callable:
    """Rows sorted by (leader, salt, role); each leader's text comes before its members'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in slices(_unpacked(batches)):
            sets = shingle_sets(column(batch, "text"), size)
            a, b = [], []
            for leader, salt, role, member, s in zip(*(column(batch, c).to_pylist() for c in ("leader", "salt", "role", "member")), sets, strict=True):
                if role == 0:
                    key, own = (leader, salt), s
                elif key == (leader, salt):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        a.append(leader)
                        b.append(member)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _links_across(rows: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Links between rows of different components; rows: (rep, component, side, band, buckets, set)."""
    rep, component, side, band = (np.array(x) for x in list(zip(*rows, strict=True))[:4])
    buckets, sets = np.array([r[4] for r in rows], np.int64), [r[5] for r in rows]
    n = np.array([len(s) for s in sets])
    across = len(np.unique(side)) > 1
    for x in range(len(rows) - 1):
        ys = x + 1 + np.flatnonzero(component[x + 1:] != component[x])
        if across:
            ys = ys[side[ys] != side[x]]
        ys = ys[100 * np.minimum(n[ys], n[x]) >= percent * np.maximum(n[ys], n[x])]
        ys = ys[(buckets[ys] == buckets[x]).argmax(axis=1) == band[x]]
        cut = np.cumsum(n[ys]) // AT_ONCE
        for part in np.split(ys, np.flatnonzero(np.diff(cut)) + 1) if len(ys) else []:
            flat = np.concatenate([sets[y] for y in part])
            place = np.minimum(np.searchsorted(sets[x], flat), n[x] - 1)
            both = np.add.reduceat((sets[x][place] == flat).astype(np.int64), np.cumsum(n[part]) - n[part])
            for y in part[100 * both >= percent * (n[part] + n[x] - both)]:
                if component[y] != component[x]:
                    component[component == component[y]] = component[x]
                    yield int(rep[x]), int(rep[y])


def _across(size: int, percent: int) -> Callable:
    """Rows sorted by (bucket, i, j): links between the blocks i and j of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            found = list(_links_across(rows, percent))
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

        key, held = None, []
        for batch in slices(_unpacked(batches)):
            sets = shingle_sets(column(batch, "text"), size)
            columns = (column(batch, c).to_pylist() for c in ("bucket", "i", "j", "rep", "component", "side", "band", "buckets"))
            for (bucket, i, j, *row), s in zip(zip(*columns, strict=True), sets, strict=True):
                if key != (bucket, i, j):
                    if held:
                        yield out(held)
                    key, held = (bucket, i, j), []
                held.append((*row, s))
        if held:
            yield out(held)

    return run


def _verified(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (leader, member) that are similar enough, as (a, b).  ``texts`` has
    one row per representative, its text packed."""
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / MEMBERS_PER_TASK)).cast("int")
    many = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).select("leader", salts.alias("salts"))
    dealt = pairs.join(many, "leader").select("leader", F.pmod(F.xxhash64("member"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"), "member")
    heads = many.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("leader").alias("member"))
    rows = dealt.unionByName(heads).join(texts, F.col("member") == F.col("doc_id")).drop("doc_id")
    together = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role", "member")
    return together.mapInArrow(_compare(size, percent), "a long, b long")


def components(links: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """node, component (smallest node reachable) of all nodes of ``links`` (a, b).

    In a round each node points to its smallest neighbour, or to itself if that is larger;
    pointers are doubled until each points to the end of its path; then every path becomes one node.  A
    node that keeps itself has no neighbour that does, so a round leaves half of a component's
    nodes at most.  ``rounds``, if given, gets the number of doublings of each round."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    labels = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent")))
        doublings = 0
        while True:
            over = parent.select(F.col("node").alias("parent"), F.col("parent").alias("end"))
            ends = cut_lineage(parent.join(over, "parent").select("node", F.col("end").alias("parent"), (F.col("end") != F.col("parent")).alias("moved")))
            parent, doublings = ends.select("node", "parent"), doublings + 1
            if ends.where("moved").isEmpty():
                break
        if rounds is not None:
            rounds.append(doublings)
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), "parent")
            labels = cut_lineage(labels.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
        pa_, pb = (parent.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab")
        moved = edges.join(pa_, "a").join(pb, "b").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).where("a <> b").distinct()
        edges = cut_lineage(moved)
        if edges.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (one row per row of ``docs``): documents with
    ``100 * intersection >= percent * union`` of their sets of ``size``-word shingles are
    linked; a component's smallest id is kept."""
    narrow = docs.select("doc_id", "text")
    feats = cut_lineage(narrow.mapInArrow(_features(size, bands, rows), "doc_id long, n_shingles long, s1 long, s2 long, buckets array<long>"))
    some = feats.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    members = cut_lineage(some.select("doc_id", "s1", "s2", "n_shingles").join(classes, ["s1", "s2", "n_shingles"]).select("doc_id", "rep", "n_shingles"))
    # a row whose id and set are the class's own; an id with several texts has several classes
    reps = members.where("doc_id = rep").select("doc_id", "n_shingles").distinct()
    spread = some.join(reps, ["doc_id", "n_shingles"]).select(F.col("doc_id").alias("rep"), F.posexplode("buckets").alias("band", "bucket")).distinct()
    heads = spread.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "leader")
    shared = cut_lineage(spread.join(heads, "bucket").select("bucket", "band", "leader", "rep"))
    pairs = shared.where("leader <> rep").select("leader", F.col("rep").alias("member")).distinct()
    pairs = cut_lineage(pairs)
    packed = narrow.where("doc_id is not null").mapInArrow(_packed, "doc_id long, text binary")
    texts = packed.join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    # rows that repeat an id: the text is the one whose set is compared, so each of them is
    texts = texts.select("doc_id", "text")
    links = cut_lineage(_verified(texts, pairs, size, percent))
    labels = components(links)
    placed = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "band", "rep", F.coalesce("component", "rep").alias("component"))
    h = F.xxhash64("rep")
    ends = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("band").alias("band"),
                                        F.bit_xor(h).alias("x"), F.sum(F.shiftrightunsigned(h, 40)).alias("s")).where("lo < hi")
    split = ends.groupBy("n", "x", "s").agg(F.min(F.struct("band", "bucket")).alias("m")).select("m.bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    side = F.pmod(h, F.col("blocks")).cast("int")
    open_ = placed.join(split, "bucket").withColumn("side", side).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.select("bucket", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "rep", "component", "side", "band")
    whole = texts.join(some.join(reps, ["doc_id", "n_shingles"], "left_semi").select("doc_id", "buckets").distinct(), "doc_id").withColumnRenamed("doc_id", "rep")
    together = open_.join(whole, "rep").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")
    more = cut_lineage(together.mapInArrow(_across(size, percent), "a long, b long"))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    found = members.select("doc_id", "n_shingles", "rep").distinct().join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.groupBy("doc_id", "n_shingles").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = feats.select("doc_id", "n_shingles").join(found, ["doc_id", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller id."""
    gone = near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    left = boxed(docs, "doc_id")
    return unboxed(docs, left.join(gone, F.col("doc_id") == F.col("gone"), "left_anti"), "doc_id")
