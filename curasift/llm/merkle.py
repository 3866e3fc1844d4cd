"""Merkle manifest of a dataset, with octopus multiproofs.

Every row is a leaf, the SHA-256 of its fields.  The leaves of a group (``lang``) ascend by
their key and make a binary tree: while several nodes remain, every two consecutive ones
become their hash, a last odd one becomes the hash of itself alone.  The roots of the groups,
in the groups' order (null first, UTF-8 bytewise), make the top tree in the same way.

1. *Positions.*  The leaf table (some 200 bytes a row, no texts) is range-partitioned and
   sorted by group and key; a row's position is its row number in its partition, plus the
   number of rows of its group in earlier partitions.
2. *Trees.*  ``2 ** HEIGHT`` consecutive leaves are one leaf partition; a task reduces it to
   its root.  The roots are the leaves of the next band, so a tree of n leaves takes
   ``log2(n) / HEIGHT`` passes, each over a 256th of the rows before.
3. *Proofs.*  Each leaf partition computes the least set of node coordinates that its leaves'
   paths need and that it can't derive from its own leaves, and fetches them by one join.
   Then it derives the interior nodes that its leaves share and writes out each leaf's proof.
   A node near the root is asked for by very many leaf partitions, so it is copied once for
   every ``BLOCK`` of them and no join key has more than ``BLOCK`` rows.

The driver sees the number of groups, whether a band is empty, and the root.

Defined results: null fields are ``-``; a null key comes first, rows equal in group and key are
ordered by their leaf (rows equal in all fields have equal leaves, in any order); a lone leaf
is its group's root, with an empty proof if the group is alone too; an empty table has no root
and no proofs.  Only the named columns are read, so extra columns don't clash."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curasift.llm.common import column, cut_lineage

#: Levels of a leaf partition, and leaf partitions that share one copy of a fetched node.
HEIGHT, BLOCK = 8, 1024
#: The tree whose leaves are the groups' roots.
TOP = -1
_NODES = "tree long, level int, idx long, width long, digest string"

Coordinate = tuple[int, int]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def widths(n: int) -> list[int]:
    """Numbers of nodes of a tree of ``n`` leaves, level by level up to the root."""
    out = [n]
    while out[-1] > 1:
        out.append((out[-1] + 1) // 2)
    return out


def missing(positions: Iterable[int], n: int) -> list[Coordinate]:
    """The least set of nodes (level, index) that the paths of the leaves at ``positions`` need
    besides what follows from these leaves, in a tree of ``n`` leaves."""
    have, out = set(positions), []
    for level, width in enumerate(widths(n)[:-1]):
        out += [(level, i ^ 1) for i in sorted(have) if i ^ 1 < width and i ^ 1 not in have]
        have = {i >> 1 for i in have}
    return out


def derive(leaves: dict[int, str], n: int, fetched: dict[Coordinate, str]) -> list[dict[int, str]]:
    """All nodes known level by level: those fetched, and those that follow."""
    levels, own = [dict(leaves)], set(leaves)
    for level in range(len(widths(n)) - 1):
        known = levels[-1]
        own = {i >> 1 for i in own}
        levels[-1] = known = known | {i: d for (at, i), d in fetched.items() if at == level}
        levels.append({i: digest(known[2 * i], known.get(2 * i + 1, "")) for i in own})
    return levels


def fold(start: str, position: int, siblings: Sequence[str | None]) -> str:
    """The root that follows from a leaf, its position and the siblings level by level."""
    for level, other in enumerate(siblings):
        start = digest(start, other or "") if not position >> level & 1 else digest(other or "", start)
    return start


def _placed(items: DataFrame, group: str, by: Sequence[str]) -> DataFrame:
    """``items`` with pos (row number from 0 in its group, ordered by ``by``) and n (rows of the group)."""
    order = [group, *by]
    dealt = cut_lineage(items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftrightunsigned("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    runs = dealt.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    same = Window.partitionBy(group)  # as many rows as partitions at most
    before = F.coalesce(F.sum("_n").over(same.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(same).alias("n"))
    placed = dealt.join(runs, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return placed.select(*items.columns, (F.col("_row") + F.col("_shift")).alias("pos"), "n")


def _tasks(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _runs(batches: Iterator[pa.RecordBatch], names: Sequence[str], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``keys`` columns; a leaf partition is such a run."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(column(batch, c).to_pylist() for c in names), strict=True):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def _reduce(base: int, lowest: int) -> Callable:
    """Nodes of ``HEIGHT`` levels above ``base``; those below ``lowest`` are left out unless a root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), rows in _runs(batches, ("tree", "chunk", "idx", "width", "digest"), 2):
            first, width, nodes, out = rows[0][0], rows[0][1], [r[2] for r in rows], []
            for level in range(base + 1, base + HEIGHT + 1):
                if width == 1:
                    break
                nodes = [digest(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
                first, width = first >> 1, (width + 1) // 2
                if level >= lowest or width == 1:
                    out += [(tree, level, first + i, width, d) for i, d in enumerate(nodes)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["tree", "level", "idx", "width", "digest"])

    return run


def _band(nodes: DataFrame, base: int, lowest: int) -> DataFrame:
    dealt = nodes.select("tree", F.shiftright("idx", HEIGHT).alias("chunk"), "idx", "width", "digest").repartition(_tasks(nodes), "tree", "chunk")
    return dealt.sortWithinPartitions("tree", "chunk", "idx").mapInArrow(_reduce(base, lowest), _NODES)


def _trees(leaves: DataFrame, whole: bool) -> DataFrame:
    """Interior nodes of all trees over ``leaves`` (tree, idx, width, digest) from level
    ``HEIGHT`` on (from 1 on if ``whole``), and the roots of smaller trees."""
    bands, base, now = [], 0, leaves
    while True:
        bands.append(cut_lineage(_band(now, base, 1 if whole or base else HEIGHT)))
        base += HEIGHT
        now = bands[-1].where((F.col("level") == base) & (F.col("width") > 1))
        if now.isEmpty():
            return reduce(DataFrame.unionByName, bands)


@dataclass
class Manifest:
    """``leaves``: gid, pos, n, key, leaf, claim; ``nodes`` and ``tops``: interior nodes of the
    groups' trees and of the top tree (tree, level, idx, width, digest); ``groups``: gid, group,
    n, subroot."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame
    groups: DataFrame
    n_groups: int
    root: str | None


def build(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", key: str = "doc_id", claim: Column | None = None) -> Manifest:
    """The manifest of all rows.  ``claim`` may give another leaf digest for a row (null: the
    row's own), which its proof is then checked with."""
    own = leaf([F.col(f"`{c}`") for c in columns])
    rows = docs.select(F.col(f"`{group}`").alias("group"), F.col(f"`{key}`").alias("key"), own.alias("leaf"), (F.lit(None).cast("string") if claim is None else claim).alias("claim"))
    # the number parts rows that are equal otherwise, so that any range can be split
    rows = cut_lineage(rows.withColumn("seq", F.monotonically_increasing_id()))
    placed = _placed(rows, "group", ("key", "leaf", "seq"))
    sizes = placed.groupBy("group").agg(F.max("n").alias("rows")).withColumn("all", F.lit(0))
    groups = cut_lineage(_placed(cut_lineage(sizes), "all", ("group",)).select("group", F.col("pos").alias("gid"), F.col("rows").alias("n")))
    named = groups.select(F.col("group").alias("_g"), "gid")
    leaves = cut_lineage(placed.join(named, F.col("group").eqNullSafe(F.col("_g"))).select("gid", "pos", "n", "key", "leaf", "claim"))
    nodes = _trees(leaves.select(F.col("gid").alias("tree"), F.col("pos").alias("idx"), F.col("n").alias("width"), F.col("leaf").alias("digest")), whole=False)
    roots = nodes.where("width = 1").select(F.col("tree").alias("gid"), F.col("digest").alias("subroot")).unionByName(leaves.where("n = 1").select("gid", F.col("leaf").alias("subroot")))
    groups = cut_lineage(groups.join(roots, "gid"))
    n_groups = groups.count()
    tops = _trees(groups.select(F.lit(TOP).cast("long").alias("tree"), F.col("gid").alias("idx"), F.lit(n_groups).cast("long").alias("width"), F.col("subroot").alias("digest")), whole=True)
    head = groups.select("subroot").first() if n_groups == 1 else tops.where("width = 1").select("digest").first()
    return Manifest(leaves, nodes, tops, groups, n_groups, head[0] if head else None)


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that each leaf partition lacks."""
    for (gid, chunk), rows in _runs(batches, ("gid", "chunk", "pos", "n"), 2):
        lacks = missing([r[0] for r in rows], rows[0][1])
        m = len(lacks)
        yield pa.RecordBatch.from_pydict({"gid": pa.array([gid] * m, pa.int64()), "chunk": pa.array([chunk] * m, pa.int64()),
                                          "level": pa.array([x for x, _ in lacks], pa.int32()), "idx": pa.array([x for _, x in lacks], pa.int64())})


def _dealt(frame: DataFrame, *then: str) -> DataFrame:
    return frame.repartition(_tasks(frame), "gid", "chunk").sortWithinPartitions("gid", "chunk", *then)


def _block(chunk: Column) -> Column:
    return F.shiftrightunsigned(chunk, BLOCK.bit_length() - 1)


def _fetch(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """gid, chunk, level, idx, digest: what the leaf partitions of ``leaves`` lack, from ``nodes``."""
    lacks = _dealt(leaves.select("gid", "chunk", "pos", "n"), "pos").mapInArrow(_requests, "gid long, chunk long, level int, idx long")
    # the leaf partitions under a node's sibling ask for it: one copy for each block of them
    sibling, up, down = "(idx ^ 1L)", f"greatest(level - {HEIGHT}, 0)", f"greatest({HEIGHT} - level, 0)"
    first = F.expr(f"shiftright(shiftleft({sibling}, {up}), {down})")
    last = F.greatest(first, F.expr(f"shiftright(shiftleft({sibling} + 1L, {up}) - 1L, {down})"))
    copies = nodes.where("width > 1").select(F.col("tree").alias("gid"), "level", "idx", "digest", F.explode(F.sequence(_block(first), _block(last))).alias("block"))
    return lacks.withColumn("block", _block(F.col("chunk"))).join(copies, ["gid", "level", "idx", "block"]).select("gid", "chunk", "level", "idx", "digest")


_ROWS = ("gid", "chunk", "role", "level", "idx", "n", "key", "digest", "claim", "tops")
_PATHS = "key long, leaf string, path array<string>, subroot string, tops array<string>, folded string"


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gid, chunk, role): the group (0), the fetched nodes (1), the leaves (2).
    Each leaf's siblings level by level, and the root that its claim folds to."""
    for (gid, _), rows in _runs(batches, _ROWS, 2):
        heads, fetched, leaves = ([r[1:] for r in rows if r[0] == role] for role in (0, 1, 2))
        subroot, tops = (heads[0][4], heads[0][6]) if heads else (None, [])
        n = leaves[0][2]
        levels = derive({r[1]: r[4] for r in leaves}, n, {(r[0], r[1]): r[4] for r in fetched})
        honest = fold(levels[-1][0], gid, tops)  # where all paths lead whose leaf claims nothing else
        out = []
        for _, pos, _, key, own, claim, _ in leaves:
            path = [levels[level].get(pos >> level ^ 1) for level in range(len(levels) - 1)]
            folded = honest if claim is None or claim == own else fold(fold(claim, pos, path), gid, tops)
            out.append((key, own, path, subroot, tops, folded))
        kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "leaf", "path", "subroot", "tops", "folded"])


def _paths(leaves: DataFrame, fetched: DataFrame, heads: DataFrame | None) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    rows = leaves.select("gid", "chunk", F.lit(2).alias("role"), none("int").alias("level"), F.col("pos").alias("idx"), "n", "key", F.col("leaf").alias("digest"), "claim", none("array<string>").alias("tops"))
    nodes = fetched.select("gid", "chunk", F.lit(1).alias("role"), "level", "idx", none("long").alias("n"), none("long").alias("key"), "digest", none("string").alias("claim"), none("array<string>").alias("tops"))
    rows = rows.unionByName(nodes)
    if heads is not None:
        rows = rows.unionByName(heads.select("gid", "chunk", F.lit(0).alias("role"), none("int").alias("level"), none("long").alias("idx"), none("long").alias("n"), none("long").alias("key"), F.col("subroot").alias("digest"), none("string").alias("claim"), "tops"))
    return _dealt(rows, "role").mapInArrow(_expand, _PATHS)


def proofs(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """key, leaf, subroot, root, siblings (from the bottom, via the group's root, to the root),
    folded_root (that of the claimed leaf), verified; for all leaves, or for those with a key
    in ``wanted`` (key).  Keys are integers."""
    chunk = F.shiftrightunsigned("pos", HEIGHT)
    leaves, nodes = manifest.leaves.withColumn("chunk", chunk), manifest.nodes.where(F.col("level") >= HEIGHT)
    if wanted is not None:
        asked = cut_lineage(leaves.join(wanted.select("key").distinct(), "key", "left_semi").select(*leaves.columns))
        # the lower nodes are not kept; those of the leaf partitions asked for are made again
        near = leaves.join(asked.select("gid", "chunk").distinct(), ["gid", "chunk"], "left_semi")
        near = near.select(F.col("gid").alias("tree"), F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("n").alias("width"), F.col("leaf").alias("digest"))
        nodes = nodes.unionByName(near).unionByName(_band(near, 0, 1).where(F.col("level") < HEIGHT))
        leaves = asked
    groups = manifest.groups.select(F.lit(TOP).cast("long").alias("gid"), F.col("gid").alias("pos"), F.lit(manifest.n_groups).cast("long").alias("n"), F.col("gid").alias("key"), F.col("subroot").alias("leaf"), F.lit(None).cast("string").alias("claim")).withColumn("chunk", chunk)
    first = groups.select(F.col("gid").alias("tree"), F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("n").alias("width"), F.col("leaf").alias("digest"))
    above = _paths(groups, _fetch(groups, manifest.tops.unionByName(first)), None)
    # a group's proof is copied once for every block of its leaf partitions
    sizes = manifest.groups.select("gid", F.sequence(F.lit(0).cast("long"), _block(F.shiftrightunsigned(F.col("n") - 1, HEIGHT))).alias("blocks"))
    heads = sizes.join(above.select(F.col("key").alias("gid"), F.col("leaf").alias("subroot"), F.col("path").alias("tops")), "gid").select("gid", F.explode("blocks").alias("block"), "subroot", "tops")
    chunks = leaves.select("gid", "chunk").distinct().withColumn("block", _block(F.col("chunk")))
    paths = _paths(leaves, _fetch(leaves, nodes), chunks.join(heads, ["gid", "block"]))
    return paths.select("key", "leaf", "subroot", F.lit(manifest.root).alias("root"), F.filter(F.concat("path", "tops"), lambda x: x.isNotNull()).alias("siblings"),
                        F.col("folded").alias("folded_root"), (F.col("folded") == F.lit(manifest.root)).alias("verified"))
