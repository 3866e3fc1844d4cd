"""SentencePiece encoding by sampling, and decoding.

A text's segmentations into pieces of a public vocabulary form a lattice; a piece's weight
falls with its rank in the vocabulary (``1 / (rank + OFFSET)``), which makes the segmentations
a distribution.  Sampling is Gumbel top-k without replacement: the best ``k`` of all
segmentations by log probability plus a Gumbel variable, found top-down.  The root of the
lattice carries its Gumbel value, which its best segmentation inherits; all others, which leave
that one at some step, are an open set with a smaller value, drawn from a Gumbel distribution of
the set's whole mass, truncated at the value.  A best-first (A*) search opens the set with the
largest value next: the step where its best segmentation leaves is drawn by mass and inherits the
value; what leaves the new segmentation later, and what is left of the set, are open sets with
smaller values.  The perturbed value is an exact bound, so nothing else is expanded.  The ``k``
results are distinct.  A segmentation with log probability p has
the inclusion score ``1 - exp(-exp(p - kappa))``, kappa being the value of the next one left.

No piece goes across the beginning of a run of spaces, or touches a byte that stands in no
longer piece; so a text's lattice is a chain of small ones, which are built once for each
distinct unit and walked by all its occurrences in a slice together.  A task keeps the lattices
over its slices until they hold ``HELD`` steps, then begins anew.  All random numbers are
hashes of the row key, the rank, the unit and the step: results don't depend on partitions.

Encoding puts one space before the text and writes unknown characters as byte pieces, as the
vocabulary's own encoder does; U+2581 itself becomes bytes too, so decoding always restores
the text.  The vocabulary (a few MB at most) is read on the driver and broadcast.

Defined results: null and empty texts have one segmentation, without pieces; a text with
fewer than ``k`` segmentations yields all of them, with inclusion score 1; rows without an id
are seeded alike; repeated rows get equal samples."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curasift.llm.common import column, mix, powers, slices, text_bytes

#: Default vocabulary file, and the constant of the rank weights.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
OFFSET = 16
#: Text bytes sampled at once.
SLICE = 1 << 19
#: Steps of lattices (some 35 bytes each) beyond which a task lets all units go before its next slice.
HELD = 1 << 21
_A, _B, _C = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_TABLE_BITS = 20


_MASK = (1 << 64) - 1


def _state(key: int, rank: int, what: int) -> np.uint64:
    """``mix`` of a row's key, a sample's rank and a purpose."""
    x = (key + rank * int(_A) + what * int(_B)) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return np.uint64(x ^ (x >> 31))


def _number(state: np.uint64) -> float:
    """``_uniform`` of one state."""
    return ((int(_state(int(state), 0, 0)) >> 11) + 0.5) * 2.0**-53


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit states."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class Vocabulary:
    pieces: list[bytes]            # bytes of each id (spaces as such; control pieces empty)
    keys: np.ndarray               # sorted hashes of all beginnings of the pieces
    ids: np.ndarray                # the id of each beginning that is a piece, else -1
    log_weight: np.ndarray         # by id
    byte_ids: np.ndarray           # id of each byte piece
    alone: np.ndarray              # bytes that stand in no piece of several characters
    longest: int
    _tables: tuple | None = field(default=None, repr=False)
    _short: tuple | None = field(default=None, repr=False)
    _names: np.ndarray | None = field(default=None, repr=False)

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, alone, usable = [], np.full(256, -1), np.ones(256, bool), {}
        for i in range(sp.get_piece_size()):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(name[1:-1], 16)
                byte_ids[value] = i
                pieces.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                pieces.append(b"")
            else:
                raw = name.replace("▁", " ").encode()
                pieces.append(raw)
                usable[raw] = i
                if len(name) > 1:
                    alone[list(set(raw))] = False
                if " " in name.replace("▁", " ").lstrip(" "):
                    raise ValueError("a piece goes across the beginning of a run of spaces")
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        ids = np.arange(len(pieces))
        weight = 1.0 / (ids + OFFSET)
        begin: dict[bytes, int] = {}
        for raw, i in usable.items():
            for n in range(1, len(raw)):
                begin.setdefault(raw[:n], -1)
            begin[raw] = i
        hashes = np.array([Vocabulary._hash(b) for b in begin], np.uint64)
        order = np.argsort(hashes)
        alone[0x80:] = False
        return Vocabulary(pieces, hashes[order], np.array(list(begin.values()))[order], np.log(weight / weight.sum()), byte_ids, alone, max(map(len, usable)))

    @staticmethod
    def _hash(raw: bytes) -> int:
        b = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
        return int(mix((b * powers(0, 64)[:len(b)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(b)))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in ``keys`` of the hashes, -1 for those that are none."""
        if self._tables is None:
            tables, rest = [], np.arange(len(self.keys))
            for shift in (64 - _TABLE_BITS, 64 - 2 * _TABLE_BITS, 0):
                table = np.full(1 << _TABLE_BITS, -1, np.int32)
                at = (self.keys[rest] >> np.uint64(shift)) & np.uint64((1 << _TABLE_BITS) - 1)
                table[at] = rest
                rest = rest[table[at] != rest]
                tables.append((np.uint64(shift), table))
            if len(rest):
                raise RuntimeError("hash tables overflow")
            self._tables = tuple(tables)
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for shift, table in self._tables:
            key = h[open_]
            got = table[(key >> shift) & np.uint64((1 << _TABLE_BITS) - 1)]
            hit = (got >= 0) & (self.keys[got] == key)
            out[open_[hit]] = got[hit]
            open_ = open_[~hit & (got >= 0)]
            if not len(open_):
                break
        return out

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` of all beginnings of one and of two bytes, -1 for those that are none."""
        if self._short is None:
            byte, table = np.arange(1, 257).astype(np.uint64), powers(0, 64)
            pairs = (byte[:, None] * table[0] + byte * table[1]).ravel()
            self._short = self.find(mix(byte * table[0] + np.uint64(1))), self.find(mix(pairs + np.uint64(2)))
        return self._short

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None, "_short": None, "_names": None}

    def decode(self, ids: Sequence[int]) -> str:
        if self._names is None:
            self._names = np.array(self.pieces, object)
        raw = b"".join(self._names[np.asarray(ids, np.intp)].tolist())
        return raw[1:].decode() if raw[:1] == b" " else raw.decode()


def _ascending(x: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 on; short ones sort by their digits."""
    return np.argsort(x.astype(np.uint16) if x.max(initial=0) < 1 << 16 else x, kind="stable")


class Lattice:
    """The lattices of distinct units, held over the slices of a task: per node its steps, longest
    first.  Units are added as slices bring them; what a unit's lattice holds doesn't depend on the others."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()
        self.is_end, self.byte = np.zeros(0, bool), np.zeros(0, np.uint8)
        self.first, self.after = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.source, self.target, self.piece = (np.zeros(0, np.int32) for _ in range(3))
        self.step, self.sums = np.zeros(0), np.zeros(0)

    def clear(self) -> None:
        """Let all units go, but not the room they took."""
        self.keys, self.heads = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hash and first node of each unit
        self.nodes = self.steps = 0

    def _append(self, at: int, **parts: np.ndarray) -> None:
        for name, part in parts.items():
            have = getattr(self, name)
            if at + len(part) > len(have):
                room = np.empty(max(at + len(part), at + at // 4), have.dtype)
                room[:at] = have[:at]
                setattr(self, name, room)
                have = room
            have[at:at + len(part)] = part

    def units(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The first node of each unit, given by its hash and its place in ``data``."""
        if self.steps > HELD:
            self.clear()
        order = np.argsort(h)
        ranked = h[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        own, where, unit = ranked[new], order[new], np.empty(len(h), np.int64)  # any occurrence will do
        unit[order] = np.cumsum(new) - 1
        place = np.searchsorted(self.keys, own)
        new = np.ones(len(own), bool)
        inside = np.flatnonzero(place < len(self.keys))
        new[inside] = self.keys[place[inside]] != own[inside]
        if new.any():
            heads = self._build(data, starts[where[new]], lens[where[new]])
            self.keys, self.heads = np.insert(self.keys, place[new], own[new]), np.insert(self.heads, place[new], heads)
            place = place + np.cumsum(new) - new
        return self.heads[place][unit]

    def _build(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Add units; their first nodes."""
        vocabulary = self.vocabulary
        total = int(lens.sum()) + len(lens)
        first_node = np.cumsum(lens + 1) - (lens + 1)
        end = np.repeat(first_node + lens, lens + 1)
        is_end = np.zeros(total, bool)
        is_end[first_node + lens] = True
        byte = np.zeros(total, np.uint8)
        inner = np.flatnonzero(~is_end)
        byte[inner] = data[inner + np.repeat(starts - first_node, lens)]
        border = ((byte & 0xC0) != 0x80) | is_end
        table = powers(0, 64)
        at = np.flatnonzero(border & ~is_end)
        lead = byte[at]
        width = np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        known = np.zeros(total, bool)
        one, two = vocabulary.short()
        h = np.zeros(len(at), np.uint64)  # of the first bytes, from the second on
        active, wide, limit = at, width, end[at]
        found = []  # by length: nodes where a step of that length begins, and its piece
        for n in range(1, vocabulary.longest + 1):
            fits = np.flatnonzero(active + n <= limit)
            if len(fits) < len(active):
                active, wide, h, limit = active[fits], wide[fits], h[fits], limit[fits]
            if not len(active):
                break
            if n == 1:
                got = one[byte[active]]
            elif n == 2:
                got = two[byte[active].astype(np.intp) << 8 | byte[active + 1]]
            else:
                h = h + (byte[active + n - 1].astype(np.uint64) + np.uint64(1)) * table[n - 1]
                got = vocabulary.find(mix(h + np.uint64(n)))
            some = np.flatnonzero(got >= 0)
            active, wide, h, limit, got = active[some], wide[some], h[some], limit[some], got[some]
            if n == 2:
                h = (byte[active].astype(np.uint64) + np.uint64(1)) * table[0] + (byte[active + 1].astype(np.uint64) + np.uint64(1)) * table[1]
            ids = vocabulary.ids[got]
            edge = np.flatnonzero((ids >= 0) & border[active + n])
            known[active[edge[wide[edge] == n]]] = True
            found.append((n, active[edge], ids[edge]))
        lost = ~known[at]
        found += [(w, at[lost & (width == w)], -1) for w in np.unique(width[lost])]
        found.sort(key=lambda x: -x[0])  # a node has one step of a length at most
        count = np.bincount(np.concatenate([x[1] for x in found]) if found else at, minlength=total)
        first = np.cumsum(count) - count
        edges = int(count.sum())
        source, target, piece = np.repeat(np.arange(total), count), np.zeros(edges, np.int64), np.full(edges, -1, np.int32)
        filled = first.copy()
        for n, nodes, ids in found:
            place = filled[nodes]
            target[place], piece[place] = nodes + n, ids
            filled[nodes] += 1
        fallback = float(vocabulary.log_weight[-1]) - 1
        weight, lost = vocabulary.log_weight[piece], np.flatnonzero(piece < 0)
        weight[lost] = fallback * (target[lost] - source[lost])
        # log mass of all ways from each node to its unit's end, nodes nearest to the end first
        mass = np.zeros(total)
        left, many = end[at] - at, count[at]
        most = int(many.max(initial=0))
        order = _ascending(left * (most + 1) + most - many)  # at one distance, those with most steps first
        near, starts, many = first[at[order]], at[order], many[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(left[order])) + 1, len(at)].tolist() if len(at) else []
        for a, b in zip(cuts, cuts[1:]):
            e, fewer = near[a:b], -many[a:b]
            value = weight[e] + mass[target[e]]
            for j in range(1, int(many[a])):
                n = int(np.searchsorted(fewer, -j))  # those with more than j steps
                more = e[:n] + j
                np.logaddexp(value[:n], weight[more] + mass[target[more]], out=value[:n])
            mass[starts[a:b]] = value
        step = np.minimum(weight + mass[target] - np.repeat(mass, count), 0.0)
        # unknown characters of one byte are pieces; longer ones stay -1 until they are written
        single = lost[target[lost] - source[lost] == 1]
        piece[single] = vocabulary.byte_ids[byte[source[single]]]
        sums, order = np.exp(step), _ascending(most - many)
        near, fewer = near[order], -many[order]
        for j in range(1, most):
            e = near[:int(np.searchsorted(fewer, -j))] + j
            sums[e] += sums[e - 1]
        sums[first[at] + count[at] - 1] = 2.0  # the last step takes what is left
        self._append(self.nodes, is_end=is_end, byte=byte, first=first + self.steps, after=first + count + self.steps)
        self._append(self.steps, source=source + self.nodes, target=target + self.nodes, piece=piece, step=step, sums=sums)
        heads = first_node + self.nodes
        self.nodes, self.steps = self.nodes + total, self.steps + edges
        return heads

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random way to the end from each node: bounds of each walker's steps, all steps."""
        active, node = np.arange(len(nodes)), nodes
        taken, count, t = [], np.zeros(len(nodes), np.int64), 0
        with np.errstate(over="ignore"):
            while len(active):
                u = _uniform(seeds + np.uint64(t + 1) * _C)
                e = self.first[node]
                more = np.flatnonzero(self.sums[e] <= u)
                while len(more):
                    e[more] += 1
                    more = more[self.sums[e[more]] <= u[more]]
                taken.append((active, e))
                t += 1
                node = self.target[e]
                over = self.is_end[node]
                count[active[over]] = t
                alive = np.flatnonzero(~over)
                active, node, seeds = active[alive], node[alive], seeds[alive]
        bounds = np.r_[0, np.cumsum(count)]
        steps = np.zeros(bounds[-1], np.int64)
        for t, (active, e) in enumerate(taken):
            steps[bounds[active] + t] = e
        return bounds, steps

    def way(self, node: int, state: np.uint64) -> list[int]:
        """A random way from one node."""
        out, t = [], 0
        with np.errstate(over="ignore"):
            while not self.is_end[node]:
                u = _number(state + np.uint64(t + 1) * _C)
                a, b = self.first[node], self.after[node]
                e = int(a + np.searchsorted(self.sums[a:b], u, side="right"))
                out.append(e)
                node = self.target[e]
                t += 1
        return out

    def ids(self, steps: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """Piece ids of the steps, unknown characters as their bytes."""
        piece = self.piece[steps]
        lost = np.flatnonzero(piece < 0)
        if not len(lost):
            return piece.astype(np.int32, copy=False)
        out, at = [], 0
        for i in lost:
            out += [piece[at:i], vocabulary.byte_ids[self.byte[self.source[steps[i]]:self.target[steps[i]]]]]
            at = i + 1
        return np.concatenate([*out, piece[at:]]).astype(np.int32)


@dataclass
class Sample:
    ids: np.ndarray
    log_prob: float
    value: float       # log probability plus Gumbel variable
    inclusion: float = 1.0


@dataclass
class _Path:
    """A way, and the open set of all ways that leave it at step ``since`` or later."""

    steps: np.ndarray
    unit_of: Callable[[int], int]    # the unit of a step
    logs: np.ndarray                 # conditional log probability of each step
    value: float
    since: int
    before: float                    # log probability of the steps before ``since``
    open: float                      # value of the open set
    left: np.ndarray | None = None   # log mass of what still leaves at each step, once opened
    taken: dict[int, list[int]] = field(default_factory=dict)  # steps already taken there

    def masses(self) -> np.ndarray:
        if self.left is None:
            logs = self.logs[self.since:]
            with np.errstate(divide="ignore"):
                self.left = self.before + np.cumsum(logs) - logs + np.log(-np.expm1(logs))
        return self.left


def _below(bound: float, mass: float, state: np.uint64) -> float:
    """A Gumbel variable of location ``mass``, truncated at ``bound``."""
    return float(-np.logaddexp(-bound, np.log(-np.log(_number(state))) - mass)) if mass > -np.inf else -np.inf


def _rest(log_prob: float) -> float:
    """Log probability of all but a way of that log probability."""
    return float(np.log(-np.expm1(log_prob))) if log_prob < 0 else -np.inf


def _search(lattice: Lattice, fresh: list, nodes: np.ndarray, row: int, span: tuple[int, int], key: np.uint64, k: int) -> list[tuple[_Path, float]]:
    """The ``k`` best perturbed segmentations of one row, and kappa with each."""
    a, b = span
    state = lambda rank, what: _state(int(key), rank, what)

    def tail(rank: int, unit: int) -> tuple[np.ndarray, Callable[[int], int]]:
        bounds, steps = fresh[rank]
        first = bounds[unit]
        return steps[first:bounds[b]], lambda i: int(np.searchsorted(bounds, first + i, side="right")) - 1

    with np.errstate(over="ignore"):
        value = float(-np.log(-np.log(_number(state(0, 1)))))
        steps, unit_of = tail(0, a)
        logs = lattice.step[steps]
        paths = [_Path(steps, unit_of, logs, value, 0, 0.0, _below(value, _rest(float(logs.sum())), state(0, 2)))]
        while True:
            best, j = max((p.open, j) for j, p in enumerate(paths))
            if len(paths) == k or best == -np.inf:
                return [(p, best) for p in paths]
            rank, parent = len(paths), paths[j]
            # the step where the next way leaves, by mass, and the step it takes instead
            left = parent.masses()
            sums = np.cumsum(np.exp(left - left.max()))
            at = int(min(np.searchsorted(sums, _number(state(rank, 6)) * sums[-1], side="right"), np.searchsorted(sums, sums[-1])))
            t = parent.since + at
            node = lattice.source[parent.steps[t]]
            gone = parent.taken.setdefault(t, [int(parent.steps[t])])
            others = np.array([e for e in range(lattice.first[node], lattice.after[node]) if e not in gone])
            p = np.exp(lattice.step[others])
            u = _number(state(rank, 3))
            step = int(others[min(np.searchsorted(np.cumsum(p), u * p.sum(), side="right"), len(others) - 1)])
            gone.append(step)
            before = float(parent.logs[:t].sum())
            rest = others[others != step]
            # what is left of the set has a value below the one it had
            left[at] = before + np.log(np.exp(lattice.step[rest]).sum()) if len(rest) else -np.inf
            top = left.max()
            parent.open = _below(best, float(top + np.log(np.exp(left - top).sum())) if top > -np.inf else -np.inf, state(rank, 4))
            unit = parent.unit_of(t)
            middle = [step, *lattice.way(int(lattice.target[step]), state(rank, 5))]
            after, after_unit = tail(rank, unit + 1)
            steps = np.concatenate([parent.steps[:t], middle, after])
            logs = np.concatenate([parent.logs[:t], lattice.step[steps[t:]]])
            before += float(logs[t])
            open_ = _below(best, before + _rest(float(logs[t + 1:].sum())), state(rank, 2))
            paths.append(_Path(steps, _units(parent, t, unit, len(middle), after_unit), logs, best, t + 1, before, open_))


def _units(parent: _Path, t: int, unit: int, middle: int, after: Callable[[int], int]) -> Callable[[int], int]:
    """Units of a way that leaves its parent at step ``t`` for ``middle`` steps of ``unit``."""
    return lambda i: parent.unit_of(i) if i < t else unit if i < t + middle else after(i - t - middle)


def sample_slice(texts: pa.Array, keys: np.ndarray, vocabulary: Vocabulary, k: int, lattice: Lattice | None = None) -> list[list[Sample]]:
    """The samples of each text, best first.  ``lattice`` holds units of earlier slices."""
    lattice = lattice or Lattice(vocabulary)
    raw, bounds = text_bytes(texts)
    some = np.flatnonzero(np.diff(bounds) > 0)
    # every text after one space
    out_bounds = np.r_[0, np.cumsum(np.diff(bounds)[some] + 1)]
    data = np.full(out_bounds[-1], 0x20, np.uint8)
    own = np.ones(len(data), bool)
    own[out_bounds[:-1]] = False
    data[own] = raw
    results: list[list[Sample]] = [[Sample(np.zeros(0, np.int32), 0.0, 0.0)] for _ in range(len(texts))]
    if not len(data):
        return results
    space, alone = data == 0x20, vocabulary.alone[data]
    begin = np.r_[True, (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]]
    begin[out_bounds[:-1]] = True
    starts = np.flatnonzero(begin)
    lens = np.diff(np.r_[starts, len(data)])
    first = np.searchsorted(starts, out_bounds)
    with np.errstate(over="ignore"):
        inside = np.arange(len(data)) - np.repeat(starts, lens)
        table = powers(1, int(lens.max()))
        h = mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * table[inside], starts) + lens.astype(np.uint64))
        nodes = lattice.units(h, data, starts, lens)
        key = mix(keys[some].astype(np.int64).view(np.uint64) + _C)
        number = np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first))
        own = np.repeat(key, np.diff(first)) + (number + 1).astype(np.uint64) * _A
        fresh = [lattice.walk(nodes, mix(own + np.uint64(rank) * _B)) for rank in range(k)]
    for i, row in enumerate(some):
        found = _search(lattice, fresh, nodes, row, (int(first[i]), int(first[i + 1])), key[i], k)
        results[row] = []
        for path, kappa in found:
            log_prob = float(path.logs.sum())
            score = -np.expm1(-np.exp(min(log_prob - kappa, 700.0))) if kappa > -np.inf else 1.0
            results[row].append(Sample(lattice.ids(path.steps, vocabulary), log_prob, path.value, float(score)))
    return results


def _keys(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def sample_encodings(docs: DataFrame, vocabulary: Vocabulary, k: int = 2) -> DataFrame:
    """doc_id, rank (from 1), ids, log_prob, perturbed, inclusion: up to ``k`` rows a document."""
    if k < 1:
        raise ValueError("k is 1 at least")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in slices(batches, max_bytes=SLICE):
            found = sample_slice(column(batch, "text"), _keys(batch, "doc_id"), shared.value, k, lattice)
            n = np.array([len(x) for x in found])
            flat = [s for x in found for s in x]
            bounds = np.r_[0, np.cumsum([len(s.ids) for s in flat])].astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": column(batch, "doc_id").take(pa.array(np.repeat(np.arange(len(n)), n))), "rank": pa.array(np.concatenate([np.arange(1, x + 1) for x in n]).astype(np.int32)),
                "ids": pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([s.ids for s in flat]))),
                **{name: pa.array([float(getattr(s, attr)) for s in flat]) for name, attr in (("log_prob", "log_prob"), ("perturbed", "value"), ("inclusion", "inclusion"))}})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, rank int, ids array<int>, log_prob double, perturbed double, inclusion double")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the text of its piece ids; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [None if x is None else shared.value.decode(x) for x in column(batch, ids).to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(got, pa.string()))

    out = encoded.withColumn(text, F.lit(None).cast("string"))
    return out.mapInArrow(run, out.schema)


def encoding_report(docs: DataFrame, vocabulary: Vocabulary, k: int = 2) -> DataFrame:
    """Per sample: doc_id, rank, n_pieces, ids_sha256 (of the ids as little-endian
    32-bit numbers), log_prob,
    perturbed, inclusion, restored (decoding gives the text back)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "doc_id long, rank int, n_pieces long, ids_sha256 string, log_prob double, perturbed double, inclusion double, restored boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in slices(batches, max_bytes=SLICE):
            rows = []
            texts, ids = column(batch, "text").to_pylist(), column(batch, "doc_id").to_pylist()
            for doc, text, found in zip(ids, texts, sample_slice(column(batch, "text"), _keys(batch, "doc_id"), shared.value, k, lattice), strict=True):
                for rank, s in enumerate(found, 1):
                    rows.append((doc, rank, len(s.ids), hashlib.sha256(s.ids.astype("<i4").tobytes()).hexdigest(), s.log_prob, s.value, s.inclusion, shared.value.decode(s.ids) == (text or "")))
            names = [x.split()[0] for x in schema.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
