"""Plain Python versions of what the operators compute."""

import re
import zlib
from collections import Counter

SF_SMALL = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeated_words(rows, width):
    """rows: (id, text); per row the words and which of them go."""
    least = {}
    for i, text in rows:
        w = SPACED.findall(text or "")
        for s in range(len(w) - width + 1):
            k = tuple(w[s:s + width])
            if i is not None:
                least[k] = min(least.get(k, i), i)
    out = []
    for i, text in rows:
        w = SPACED.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if i is not None and least[tuple(w[s:s + width])] < i:
                gone[s:s + width] = [True] * width
        out.append((w, gone))
    return out


def contamination(rows, items, width=13):
    wins = {}
    for i, text in items:
        w = ALNUM.findall(lower(text))
        for s in range(max(1, len(w) - width + 1) if w else 0):
            wins.setdefault(tuple(w[s:s + width]), set()).add("" if i is None else str(i))
    out = []
    for _, text in rows:
        w = ALNUM.findall(lower(text))
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in wins:
                    hit[s:s + n] = [True] * n
                    found |= wins[tuple(w[s:s + n])]
        out.append((len(w), sum(hit), sorted(found)))
    return out


def shingles(text, size):
    w = SPACED.findall(lower(text))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(rows, size, percent=80):
    """rows: (id, text) with distinct ids; the smallest id reachable from each."""
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        both = Counter(o for g in s for o in holders.get(g, ()))
        for o, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = sorted((top(i), top(o)))
                parent[b] = a
        for g in s:
            holders.setdefault(g, []).append(i)
    return {i: top(i) for i in sets}


def base_scores(rows):
    """Per row: tokens, known tokens, base score; and the training tokens."""
    import math
    tokens = [SPACED.findall(lower(t)) + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    return [(len(t), sum(count[w] > 0 for w in t), sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)) for t in tokens], n


def text_statistics(text):
    w = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
