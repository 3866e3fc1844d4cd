"""Language-model scoring with a causal self-attention model over subword ids.

Texts are lower-cased (A-Z) words and an end.  Each word, with its leading space, is cut into
pieces of a public vocabulary by longest match.  The model is one masked self-attention layer
and one feed-forward layer in numpy over *classes*: the ``HEAD`` most frequent pieces are
classes of their own, the others share classes by kind; within a class a piece has its share of
the counts over all training documents (plus one).  Classes stand in ``GROUPS`` groups of
``MEMBERS``, and the output is a softmax over the groups and one over the group's members.  A
text's log probability is the sum over its pieces and the end.

Scoring cuts a text into windows of ``WINDOW`` inputs, ``STRIDE`` apart.  A window scores only
the inputs that no earlier window has scored, so each token is scored once, with at least
``WINDOW - STRIDE`` inputs of context after the first window; windows of many texts go through
the masked attention in one batch.

Training is model averaging: in each round every partition starts from the same weights, takes
Adam steps on the windows of the round's training documents, and the weights are averaged by
tokens in Spark (two levels).  A hash deals the training documents over the rounds, so the
rounds together train on all windows of all training documents, whatever the size of the
corpus; training windows don't overlap, so a round takes each of its tokens once.  Where a round's share would be under ``LEAST_WORDS``, documents of other rounds are
repeated in it.  Word and piece counts are taken over all training documents.

The baseline (add-one word unigrams) needs each word's count.  The ``HOT`` most frequent words
are broadcast (a fixed bound) and settle most tokens in place; the rest go through a join as one
row for each document and rare word, so no key of the join is hot.  Words are keyed by 64-bit
hashes.

Defined results: null and empty texts consist of the end alone; rows without an id are training
documents; repeated rows are scored alike; with an empty table the result is empty."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curasift.llm.common import SPACES, Words, column, cut_lineage, mix, powers, signed, slices, words
from curasift.llm.subword import MODEL, Vocabulary

#: Classes of single pieces, classes of other pieces, end, begin.
GROUPS, MEMBERS, TAIL = 32, 32, 32
CLASSES = GROUPS * MEMBERS
HEAD = CLASSES - TAIL - 2
END, BEGIN = HEAD + TAIL, HEAD + TAIL + 1
WIDTH, HIDDEN, WINDOW, STRIDE = 32, 64, 32, 24
#: Rounds, words of a round up to which documents are repeated, windows of a step, least steps of a fit.
ROUNDS, LEAST_WORDS, BATCH, LEAST_STEPS = 3, 1_500_000, 64, 120
#: Words whose counts are broadcast; distinct words held in a task.
HOT, FLUSH = 1 << 18, 2_000_000
_SHAPES = {"e": (CLASSES, WIDTH), "p": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH),
           "w1": (WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, WIDTH),
           "s": (WIDTH, GROUPS), "sb": (GROUPS,), "u": (GROUPS, WIDTH, MEMBERS), "b": (GROUPS, MEMBERS)}
_SIZE = sum(math.prod(s) for s in _SHAPES.values())
_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
_PAST = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_SCALE = np.float32(1 / math.sqrt(WIDTH))


# ---------------------------------------------------------------- subword ids

def distinct(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the distinct words, ascending, a place of each, and which of them each word
    is; any place will do, so the sort need not be stable."""
    h = found.hashes()
    order = np.argsort(h)
    h = h[order]
    new = np.r_[True, h[1:] != h[:-1]][:len(h)]
    unit = np.empty(len(h), np.int64)
    unit[order] = np.cumsum(new) - 1
    return h[new], order[new], unit


def longest_match(vocabulary: Vocabulary, found: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and piece ids of the chosen words, each after a space, by longest match."""
    starts, lens = found.starts[which], found.ends[which] - found.starts[which] + 1
    first = np.cumsum(lens) - lens
    total = int(lens.sum())
    inside = np.arange(total) - np.repeat(first, lens)
    byte = found.data[np.maximum(np.repeat(starts, lens) + inside - 1, 0)] if total else np.zeros(0, np.uint8)
    byte[first] = 0x20
    border = np.r_[(byte & 0xC0) != 0x80, True]
    value = byte.astype(np.uint64) + np.uint64(1)
    table = powers(0, 64)
    at, end, owner = first.copy(), first + lens, np.arange(len(which))
    taken, step, count = [], 0, np.zeros(len(which), np.int64)
    while len(at):
        best, size = np.full(len(at), -1), np.ones(len(at), np.int64)
        # the places where a piece may still go on: their numbers, what comes next and what is left
        active, go, left, h = np.arange(len(at)), at, end - at, np.zeros(len(at), np.uint64)
        for n in range(1, vocabulary.longest + 1):
            on = np.flatnonzero(left >= n)
            if not len(on):
                break
            if len(on) < len(active):
                active, go, left, h = active[on], go[on], left[on], h[on]
            h = h + value[go] * table[n - 1]
            got = vocabulary.find(mix(h + np.uint64(n)))
            on = np.flatnonzero(got >= 0)
            active, go, left, h = active[on], go[on] + 1, left[on], h[on]
            ids = vocabulary.ids[got[on]]
            whole = np.flatnonzero((ids >= 0) & border[go])
            best[active[whole]], size[active[whole]] = ids[whole], n
        lost = best < 0  # an unknown character goes byte by byte
        best[lost] = vocabulary.byte_ids[byte[at[lost]]]
        taken.append((owner, best))
        count[owner] += 1
        at = at + size
        alive = at < end
        at, end, owner = at[alive], end[alive], owner[alive]
        step += 1
    bounds = np.r_[0, np.cumsum(count)]
    out = np.zeros(bounds[-1], np.int32)
    for t, (owner, best) in enumerate(taken):
        out[bounds[owner] + t] = best
    return bounds, out


def _expand(bounds: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the entries of the chosen groups, group after group."""
    n = bounds[which + 1] - bounds[which]
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[which], n)


# ---------------------------------------------------------------- the model

@dataclass
class Model:
    vocabulary: Vocabulary
    class_of: np.ndarray     # by piece id
    share: np.ndarray        # log probability of a piece within its class
    weights: np.ndarray      # all parameters

    def sequences(self, found: Words, texts: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds, classes and within-class log probabilities of each text's pieces and end;
        ``known``: a place of each distinct word, and which of them each word is."""
        where, unit = known or distinct(found)[1:]
        bounds, ids = longest_match(self.vocabulary, found, where)
        n = np.diff(bounds)[unit]
        place = _expand(bounds, unit)
        ends = np.r_[0, np.cumsum(n)][found.offsets[1:]] if len(unit) else np.zeros(texts, np.int64)
        out_bounds = np.r_[0, ends + np.arange(1, texts + 1)]
        classes, share = np.full(out_bounds[-1], END, np.int32), np.zeros(out_bounds[-1])
        piece = np.ones(out_bounds[-1], bool)
        piece[out_bounds[1:] - 1] = False
        classes[piece], share[piece] = self.class_of[ids][place], self.share[ids][place]
        return out_bounds, classes, share


def _params(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = math.prod(shape)
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


def initial(rates: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(11)
    flat = (rng.standard_normal(_SIZE) * 0.08).astype(np.float32)
    w = _params(flat)
    w["u"] *= 0.25
    w["s"] *= 0.25
    w["b1"][:] = 0
    w["sb"][:] = np.log(rates.reshape(GROUPS, MEMBERS).sum(axis=1))
    w["b"][:] = np.log(rates.reshape(GROUPS, MEMBERS))
    return flat


def _mixed(w: dict[str, np.ndarray]) -> np.ndarray:
    """What a place asks by, ``q @ k.T`` (scaled), beside what it gives, ``v @ o``: one product
    for both, and the keys are the inputs themselves."""
    return np.concatenate([w["q"] @ w["k"].T * w["q"].dtype.type(_SCALE), w["v"] @ w["o"]], axis=1)


def _sums(a: np.ndarray) -> np.ndarray:
    """Sums over the last axis, kept as an axis of one."""
    return (a.reshape(-1, a.shape[-1]) @ np.ones(a.shape[-1], a.dtype)).reshape(*a.shape[:-1], 1)


def _attention(asks: np.ndarray, keys: np.ndarray, first: int = 0) -> np.ndarray:
    """Attention of the places from ``first`` on to themselves and those before."""
    a = asks @ keys.transpose(0, 2, 1)
    if a.max(initial=0) > 60 or a.diagonal(first, 1, 2).min(initial=0) < -60:  # else exp is safe
        a += _MASK[first:keys.shape[1], :keys.shape[1]]
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
    else:
        np.exp(a, out=a)
        a *= _PAST[first:keys.shape[1], :keys.shape[1]]
    a *= 1 / _sums(a)
    return a


def _embedded(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    h0 = w["e"].take(x.ravel(), axis=0).reshape(*x.shape, WIDTH)
    h0 += w["p"][:x.shape[1]]
    return h0


def forward(w: dict[str, np.ndarray], x: np.ndarray, rows: np.ndarray | None = None) -> tuple:
    """What stands before the output at every place of the windows (or at ``rows``), and
    what the gradient needs."""
    h0, mixed = _embedded(w, x), _mixed(w)
    t = (h0.reshape(-1, WIDTH) @ mixed).reshape(*x.shape, 2 * WIDTH)
    a = _attention(t[..., :WIDTH], h0)
    h1 = a @ t[..., WIDTH:]
    h1 += h0
    h1 = h1.reshape(-1, WIDTH)
    if rows is not None:
        h1 = h1.take(rows, axis=0)
    z = h1 @ w["w1"]
    z += w["b1"]
    np.maximum(z, 0, out=z)
    return h1 + z @ w["w2"], (h0, mixed, t, a, h1, z)


def hidden(w: dict[str, np.ndarray], x: np.ndarray, first: int, mixed: np.ndarray | None = None) -> np.ndarray:
    """``forward`` for the places from ``first`` on of each window, all that scoring needs."""
    h0, mixed = _embedded(w, x), _mixed(w) if mixed is None else mixed
    h1 = np.ascontiguousarray(h0[:, first:])
    asks = (h1.reshape(-1, WIDTH) @ mixed[:, :WIDTH]).reshape(h1.shape)
    gives = (h0.reshape(-1, WIDTH) @ mixed[:, WIDTH:]).reshape(h0.shape)
    c = _attention(asks, h0, first) @ gives
    c += h1
    h1 = c.reshape(-1, WIDTH)
    z = h1 @ w["w1"]
    z += w["b1"]
    np.maximum(z, 0, out=z)
    return h1 + z @ w["w2"]


def _safe(logits: np.ndarray) -> np.ndarray:
    """The logits, moved where exp could overflow or vanish."""
    if logits.max(initial=0) > 60 or logits.min(initial=0) < -60:
        logits -= logits.max(axis=1, keepdims=True)
    return logits


def _softmax(logits: np.ndarray) -> np.ndarray:
    np.exp(_safe(logits), out=logits)
    logits *= 1 / _sums(logits)
    return logits


def _picked(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log softmax of each row at its target."""
    own = _safe(logits)[np.arange(len(logits)), target]
    np.exp(logits, out=logits)
    return own - np.log(_sums(logits).ravel())


def _member_logits(w: dict[str, np.ndarray], h2: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Logits of each row within the group of its target, and the rows of each group; targets ascend."""
    ends = np.searchsorted(target, np.arange(1, GROUPS + 1) * MEMBERS).tolist()
    spans = [(g, i, j) for g, (i, j) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if i < j]
    logits = np.empty((len(h2), MEMBERS), h2.dtype)
    for g, i, j in spans:
        np.matmul(h2[i:j], w["u"][g], out=logits[i:j])
        logits[i:j] += w["b"][g]
    return logits, spans


def _ascending(target: np.ndarray) -> np.ndarray:
    """The order of the classes (few, so a sort of short numbers)."""
    return np.argsort(target.astype(np.uint16), kind="stable")


def log_likelihood(w: dict[str, np.ndarray], h2: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of each target class."""
    order = _ascending(target)
    h2, target = h2.take(order, axis=0), target[order]
    logs = _picked(h2 @ w["s"] + w["sb"], target // MEMBERS)
    logs += _picked(_member_logits(w, h2, target)[0], target % MEMBERS)
    out = np.empty_like(logs)
    out[order] = logs
    return out


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss, and the gradient of the mean loss."""
    on = np.flatnonzero(live.ravel())
    target = y.ravel()[on]
    order = _ascending(target)
    on, target = on[order], target[order]
    h2, (h0, mixed, t, a, h1, z) = forward(w, x, on)
    flat = np.zeros(_SIZE, w["e"].dtype)
    g = _params(flat)
    share = w["e"].dtype.type(1 / max(1, len(on)))
    at, loss = np.arange(len(on)), 0.0
    logits, spans = _member_logits(w, h2, target)
    outer, inner = _softmax(h2 @ w["s"] + w["sb"]), _softmax(logits)
    for p, own in ((outer, target // MEMBERS), (inner, target % MEMBERS)):
        hit = p[at, own]
        loss -= float(np.log(hit).sum())
        p[at, own] = hit - 1
        p *= share
    g["s"][:], g["sb"][:] = h2.T @ outer, outer.sum(axis=0)
    d2 = np.empty_like(h2)
    for group, i, j in spans:
        p = inner[i:j]
        np.matmul(h2[i:j].T, p, out=g["u"][group])
        np.matmul(p, w["u"][group].T, out=d2[i:j])
    if spans:
        g["b"][[x[0] for x in spans]] = np.add.reduceat(inner, [x[1] for x in spans], axis=0)
    d2 += outer @ w["s"].T
    g["w2"][:] = z.T @ d2
    dz = d2 @ w["w2"].T
    dz *= z > 0
    g["w1"][:], g["b1"][:] = h1.T @ dz, dz.sum(axis=0)
    d2 += dz @ w["w1"].T
    d1 = (np.empty if len(on) == x.size else np.zeros)((x.size, WIDTH), d2.dtype)
    d1[on] = d2
    d1 = d1.reshape(h0.shape)
    # a place's asking and giving, and what it is as a key
    ds = d1 @ t[..., WIDTH:].transpose(0, 2, 1)
    ds *= a
    ds -= a * _sums(ds)
    dt = np.empty_like(t)
    np.matmul(ds, h0, out=dt[..., :WIDTH])
    np.matmul(a.transpose(0, 2, 1), d1, out=dt[..., WIDTH:])
    d1 += ds.transpose(0, 2, 1) @ t[..., :WIDTH]
    d0, dt = d1.reshape(-1, WIDTH), dt.reshape(-1, 2 * WIDTH)
    d0 += dt @ mixed.T
    dm = h0.reshape(-1, WIDTH).T @ dt
    asked, given = dm[:, :WIDTH] * _SCALE, dm[:, WIDTH:]
    g["q"][:], g["k"][:] = asked @ w["k"], asked.T @ w["q"]
    g["v"][:], g["o"][:] = given @ w["o"].T, w["v"].T @ given
    g["p"][:x.shape[1]] = d1.sum(axis=0)
    order = _ascending(x.ravel())
    sorted_x = x.ravel()[order]
    first = np.flatnonzero(np.r_[True, sorted_x[1:] != sorted_x[:-1]])
    g["e"][sorted_x[first]] = np.add.reduceat(d0.take(order, axis=0), first, axis=0)
    return loss, flat


def _windows(bounds: np.ndarray, stride: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Text and first input of each window."""
    n = np.diff(bounds)
    many = 1 + np.maximum(0, -(-(n - WINDOW) // stride))
    text = np.repeat(np.arange(len(n)), many)
    number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return text, number * stride


def _inputs(bounds: np.ndarray, classes: np.ndarray, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and real places of the windows; the begin stands before each text."""
    place = first[:, None] + np.arange(WINDOW)
    n = np.diff(bounds)[text][:, None]
    live = place < n
    at = bounds[:-1][text][:, None] + np.minimum(place, n - 1)
    y = classes[at]
    x = np.where(place > 0, classes[np.maximum(at - 1, 0)], BEGIN)
    return x, y, live


def log_probabilities(model: Model, bounds: np.ndarray, classes: np.ndarray, batch: int = 256) -> np.ndarray:
    """Log probability (base e) of the class of each token, each scored once.  First windows
    score all their inputs, later ones the last ``STRIDE``."""
    w = _params(model.weights)
    mixed = _mixed(w)
    out = np.zeros(len(classes))
    # the input of each token is the token before; what lies beyond a text's end is not scored,
    # and what comes later is masked for what is
    before = np.r_[np.int32(BEGIN), classes[:-1]]
    before[bounds[:-1]] = BEGIN
    text, start = _windows(bounds, STRIDE)
    start, end = bounds[:-1][text] + start, bounds[1:][text]
    fresh = np.r_[True, text[1:] != text[:-1]]
    for which, first in ((np.flatnonzero(fresh), 0), (np.flatnonzero(~fresh), WINDOW - STRIDE)):
        for a in range(0, len(which), batch):
            own = which[a:a + batch]
            n = min(WINDOW, int((end[own] - start[own]).max()))
            at = start[own][:, None] + np.arange(n)
            live = (at < end[own][:, None])[:, first:].ravel()
            np.minimum(at, len(classes) - 1, out=at)
            place = at[:, first:].ravel()[live]
            h2 = hidden(w, before[at], first, mixed)
            out[place] = log_likelihood(w, h2 if live.all() else h2[live], classes[place])
    return out


def steps_over(bounds: np.ndarray) -> int:
    """Steps in which each window is trained on at least once."""
    return max(LEAST_STEPS, -(-len(_windows(bounds)[0]) // BATCH))


def train(model: Model, bounds: np.ndarray, classes: np.ndarray, seed: int, steps: int, rate: float) -> tuple[np.ndarray, int]:
    """Adam steps on shuffled windows; the new weights and the number of trained tokens."""
    rng = np.random.default_rng(seed)
    flat = model.weights.astype(np.float32).copy()
    m, v, done = np.zeros_like(flat), np.zeros_like(flat), 0
    text, first = _windows(bounds)
    order = rng.permutation(len(text))
    for t in range(1, steps + 1):
        a = (t - 1) * BATCH % max(1, len(order))
        own = order[a:a + BATCH]
        x, y, live = _inputs(bounds, classes, text[own], first[own])
        _, g = _gradient(_params(flat), x, y, live)
        m *= np.float32(0.9)
        m += np.float32(0.1) * g
        v *= np.float32(0.99)
        g *= g
        g *= np.float32(0.01)
        v += g
        np.multiply(v, np.float32(1 / (1 - 0.99**t)), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-6)
        np.divide(m, g, out=g)
        g *= np.float32(rate * min(1, t / 10) * (1 - 0.9 * t / steps) / (1 - 0.9**t))
        flat -= g
        done += int(live.sum())
    return flat, done


# ---------------------------------------------------------------- over the corpus

def held_out() -> Column:
    """Documents that are not learned from: crc32 of the id's text, modulo 7, is 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


def dealt(rounds: int) -> Column:
    """The round that trains on a document."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))


def _split(batch: pa.RecordBatch) -> Words:
    return words(column(batch, "text"), SPACES, lower=True)


def _counts(shared):
    """Words (kind 0, by hash) and pieces (kind 1, by id) of training documents."""

    def sent(held: list) -> pa.RecordBatch:
        key, kind, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((key, kind))
        key, kind, n = key[order], kind[order], n[order]
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])])
        return pa.RecordBatch.from_pydict({"key": pa.array(signed(key[cut])), "kind": pa.array(kind[cut].astype(np.int32)), "n": pa.array(np.add.reduceat(n, cut))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            found = _split(batch)
            if not len(found.starts):
                continue
            h, where, unit = distinct(found)
            n = np.bincount(unit)
            bounds, ids = longest_match(shared.value, found, where)
            pieces = np.bincount(ids, np.repeat(n, np.diff(bounds)), len(shared.value.pieces)).astype(np.int64)
            some = np.flatnonzero(pieces)
            held += [(h, np.zeros(len(h), np.int8), n), (some.astype(np.uint64), np.ones(len(some), np.int8), pieces[some])]
            size += len(h)
            if size >= FLUSH:
                yield sent(held)
                held, size = [], 0
        if held:
            yield sent(held)

    return run


def _classes(vocabulary: Vocabulary, pieces: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each piece, log share within it, and the rates of the classes."""
    order = np.argsort(-pieces, kind="stable")
    class_of = np.zeros(len(pieces), np.int32)
    head = sorted(order[:HEAD], key=lambda i: (vocabulary.pieces[i], i))  # like beginnings in one group
    class_of[head] = np.arange(len(head))
    rest = order[HEAD:]
    for rank, i in enumerate(rest):
        raw = vocabulary.pieces[i]
        kind = (raw[:1] == b" ") + 2 * any(c > 0x7F for c in raw)
        class_of[i] = HEAD + 8 * kind + min(7, int(math.log2(1 + rank / 100)))
    n = pieces + 1.0
    total = np.bincount(class_of, n, CLASSES)
    total[END] = docs + 1
    total[BEGIN] = 1e-3
    return class_of, np.log(n / total[class_of]), np.maximum(total, 1e-3) / total.sum()


def _averaged(docs: DataFrame, model: Model, number: int, rate: float) -> np.ndarray:
    """One round: partitions train from the same weights, which are averaged by tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, classes = [np.zeros(1, np.int64)], []
        total = 0
        weights, weight = None, 0

        def fitted() -> tuple[np.ndarray, int]:
            b, c = np.concatenate(bounds), np.concatenate(classes)
            start = Model(shared.value.vocabulary, shared.value.class_of, shared.value.share, shared.value.weights if weights is None else weights)
            return train(start, b, c, number, steps_over(b), rate)

        for batch in slices(batches):
            b, c, _ = shared.value.sequences(_split(batch), batch.num_rows)
            bounds.append(b[1:] + total)
            classes.append(c)
            total += len(c)
            if total > FLUSH:
                weights, n = fitted()
                weight += n
                bounds, classes, total = [np.zeros(1, np.int64)], [], 0
        if classes:
            weights, n = fitted()
            weight += n
        if weights is not None:
            yield pa.RecordBatch.from_pydict({"n": pa.array([float(weight)]), "w": pa.array([weights.astype(np.float32).tobytes()], pa.binary())})

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, acc = 0.0, np.zeros(_SIZE)
        for batch in batches:
            for n, raw in zip(column(batch, "n").to_pylist(), column(batch, "w").to_pylist(), strict=True):
                acc += n * np.frombuffer(raw, np.float32)
                total += n
        if total:
            yield pa.RecordBatch.from_pydict({"n": pa.array([total]), "w": pa.array([(acc / total).astype(np.float32).tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(learn, "n double, w binary").repartition(16).mapInArrow(combine, "n double, w binary").collect()  # 16 rows at most
    if not parts:
        return model.weights
    return (sum(x.n * np.frombuffer(x.w, np.float32) for x in parts) / sum(x.n for x in parts)).astype(np.float32)


@dataclass
class Scorer:
    model: Model
    counts: DataFrame    # word (hash), n
    tokens: int          # training tokens, ends included
    distinct: int        # distinct training tokens, the end included
    ends: int            # training documents


def fit(docs: DataFrame, model_path: str = MODEL, rounds: int = ROUNDS) -> Scorer:
    """Counts over all training documents and the averaged model."""
    vocabulary = Vocabulary.load(model_path)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    known = docs.select("doc_id", "text").where(~held_out())
    table = cut_lineage(known.select("text").mapInArrow(_counts(shared), "key long, kind int, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    counts = table.where("kind = 0").select(F.col("key").alias("word"), "n")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = known.count()
    pieces = np.zeros(len(vocabulary.pieces), np.int64)
    for x in table.where("kind = 1").select("key", "n").collect():  # one row a piece
        pieces[x.key] = x.n
    class_of, share, rates = _classes(vocabulary, pieces, ends)
    model = Model(vocabulary, class_of, share, initial(rates))
    again = max(0.0, (min(1.0, LEAST_WORDS / max(1, whole.n)) * rounds - 1) / max(1, rounds - 1))
    u = lambda r: F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(r)), 11) * F.lit(2.0**-53)
    for r in range(rounds if whole.n else 0):
        model.weights = _averaged(known.where((dealt(rounds) == r) | (u(r) < again)), model, r, 0.005 if 0 < r == rounds - 1 else 0.01)
    return Scorer(model, counts, whole.n + ends, whole.v + (1 if ends else 0), ends)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (base 10)."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(scorer.model)
    hot = scorer.counts.orderBy(F.col("n").desc(), "word").limit(HOT).toArrow()  # a fixed bound
    hot_words = hot["word"].to_numpy().view(np.uint64)
    order = np.argsort(hot_words)
    hot_shared = sc.broadcast((hot_words[order], hot["n"].to_numpy()[order]))
    floor = math.log10(scorer.tokens + scorer.distinct + 1)
    end_score, ends = math.log10(scorer.ends + 1) - floor, scorer.ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, n_ = hot_shared.value
        for batch in slices(batches):
            found, rows = _split(batch), batch.num_rows
            h, where, unit = distinct(found)
            doc = found.docs()
            place = np.minimum(np.searchsorted(words_, h), max(0, len(words_) - 1))
            hot_ = words_[place] == h if len(words_) else np.zeros(len(h), bool)
            own = np.zeros(len(h))
            own[hot_] = np.log10(n_[place[hot_]] + 1.0) - floor
            hit = hot_[unit]
            base = np.bincount(doc[hit], own[unit[hit]], rows) + end_score
            known = np.bincount(doc[hit], minlength=rows) + (ends > 0)
            # by text, then by word: the distinct words ascend
            pair, times = np.unique(doc[~hit] * max(1, len(h)) + unit[~hit], return_counts=True)
            at, rare = np.divmod(pair, max(1, len(h)))
            lists = np.searchsorted(at, np.arange(rows + 1)).astype(np.int32)
            bounds, classes, share = scorer_model().sequences(found, rows, (where, unit))
            logs = log_probabilities(scorer_model(), bounds, classes) + share
            yield pa.RecordBatch.from_pydict({
                "doc_id": column(batch, "doc_id"), "held_out": column(batch, "held_out"), "n_tokens": pa.array(np.diff(found.offsets) + 1),
                "known": pa.array(known.astype(np.int64)), "base": pa.array(base), "score": pa.array(np.add.reduceat(logs, bounds[:-1]) / math.log(10)),
                "rare": pa.ListArray.from_arrays(pa.array(lists), pa.array(signed(h[rare]))), "times": pa.ListArray.from_arrays(pa.array(lists), pa.array(times.astype(np.int32)))})

    def scorer_model() -> Model:
        return shared.value

    rows = docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, times array<int>")
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(scorer.counts, "word", "left")
    more = found.groupBy("row").agg(F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - F.lit(floor))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"))
    return rows.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"), F.lit(scorer.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
