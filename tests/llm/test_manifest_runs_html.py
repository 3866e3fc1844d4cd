import hashlib
import random
import zlib

import pytest
from llm_fixtures import DOCS, edge, llm_spark, nothing  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from curasift.llm import html_extract, merkle, periodic_runs
from curasift.llm import queries as Q


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, i):
    return [x[j] for k, x in enumerate(levels[:-1]) if (j := i >> k ^ 1) < len(x)]


def manifest(rows):
    """rows (doc_id, source, lang, n_chars, text): sorted (doc_id, leaf, subroot, root, siblings)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(*r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = [(i, own, trees[g][-1][0], top[-1][0], tuple(siblings(trees[g], at) + siblings(top, k))) for k, g in enumerate(order) for at, (i, own) in enumerate(groups[g])]
    return sorted(out, key=str)


def _proofs(spark, rows, wanted=None, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("leaf", F.lit(1)).withColumn("pos", F.lit("x"))
    return merkle.proofs(merkle.build(docs, **kw), wanted)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, None: 1}, {"é": 3, "z": 5, "Z": 1, "": 2}, {"en": 700, "de": 257, None: 256}])
def test_proofs(llm_spark, sizes):
    r = random.Random(4)
    rows = [(i, r.choice(("s", None, "ß")), g, r.choice((None, i)), r.choice(("", None, "téxt", "x" * 300))) for i, g in enumerate(g for g, n in sizes.items() for _ in range(n))]
    r.shuffle(rows)
    tampered = [F.col(c) for c in ("doc_id", "source", "lang")] + [F.col("n_chars") + 1, F.col("text")]
    got = _proofs(llm_spark, rows, claim=F.when(F.col("doc_id") % 3 == 0, merkle.leaf(tampered))).collect()
    assert sorted(((x.key, x.leaf, x.subroot, x.root, tuple(x.siblings)) for x in got), key=str) == manifest(rows)
    chars = {x[0]: x[3] for x in rows}
    for x in got:
        assert x.verified == (x.key % 3 != 0 or chars[x.key] is None) and x.verified == (x.folded_root == x.root)


def test_proofs_of_some_leaves(llm_spark):
    rows = [(i, "s", "en" if i % 5 else "de", i, f"text {i}") for i in range(1500)]
    wanted = {1, 2, 3, 700, 1499, 5, 10}
    got = _proofs(llm_spark, rows, llm_spark.createDataFrame([(i,) for i in [*wanted, 9999]], "key long")).collect()
    assert sorted(((x.key, x.leaf, x.subroot, x.root, tuple(x.siblings)) for x in got), key=str) == [x for x in manifest(rows) if x[0] in wanted] and all(x.verified for x in got)


def test_proofs_on_edges(llm_spark, edge, nothing):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in edge.collect()]
    got = merkle.proofs(merkle.build(edge)).collect()
    assert sorted(((x.key, x.leaf, x.subroot, x.root, tuple(x.siblings)) for x in got), key=str) == manifest(rows) and all(x.verified for x in got)
    empty = merkle.build(nothing)
    assert empty.root is None and merkle.proofs(empty).count() == 0


def test_repeated_rows_spread(llm_spark):
    """A third of all rows equal in every field still make balanced ranges."""
    rows = [(7, "s", "en", 1, "same")] * 500 + [(i, "s", "en", 1, "t") for i in range(100, 1100)]
    found = merkle.build(llm_spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    assert sorted(x.pos for x in found.leaves.collect()) == list(range(1500)) and found.root == manifest(rows)[0][3]


def test_missing_is_least():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 40)
        own = sorted(r.sample(range(n), r.randint(1, n)))
        lacks = merkle.missing(own, n)
        levels = tree([str(i) for i in range(n)])
        known = merkle.derive({i: str(i) for i in own}, n, {(k, i): levels[k][i] for k, i in lacks})
        assert known[-1][0] == levels[-1][0]
        for drop in lacks:  # none can be spared
            with pytest.raises((KeyError, AssertionError)):
                rest = merkle.derive({i: str(i) for i in own}, n, {(k, i): levels[k][i] for k, i in lacks if (k, i) != drop})
                assert rest[-1][0] == levels[-1][0]


def brute_runs(words, exponent=4, least=6):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def test_runs_of_words():
    r = random.Random(5)
    for _ in range(800):
        words = [bytes([97 + r.randrange(r.choice((1, 2, 3, 5)))]) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            if words:
                a, p = r.randrange(len(words)), r.randint(1, 6)
                words[a:a] = words[a:a + p] * r.randint(2, 7)
        for exponent, least in ((4, 6), (2, 2), (3, 5)):
            assert periodic_runs.runs_of(words, exponent, least) == brute_runs(words, exponent, least)
    words = [b"%d" % r.randrange(900) for _ in range(5000)] * 4 + [b"x"] * 10_000
    assert periodic_runs.runs_of(words) == [(0, 20_000, 5000), (20_000, 10_000, 1)]


def test_common_extension():
    r = random.Random(8)
    for k in (1, 2, 4):
        s = [r.randrange(k) for _ in range(300)]
        t = periodic_runs.SuffixTree(s)
        import numpy as np
        i = np.array([r.randrange(300) for _ in range(2000)])
        j = np.array([r.randrange(300) for _ in range(2000)])
        i, j = i[i != j], j[i != j]
        want = [next((d for d in range(300) if max(a, b) + d >= 300 or s[a + d] != s[b + d])) for a, b in zip(i, j, strict=True)]
        assert t.common(i, j).tolist() == want
        assert sorted(range(300), key=lambda a: t.rank[a]) == sorted(range(300), key=lambda a: s[a:])
        assert sorted(range(300), key=lambda a: t.late[a]) == sorted(range(300), key=lambda a: [*s[a:], k])


def test_run_report_on_edges(llm_spark, edge, nothing):
    docs = edge.unionByName(llm_spark.createDataFrame([(20, "a b " * 9 + "a c", "en", "s", 1, "w", 7, "x", "y")], DOCS))
    out = {}
    for prepare in (None, Q.looped):
        for x in periodic_runs.run_report(docs, prepare).collect():
            text = next(r.text for r in docs.collect() if r.doc_id == x.doc_id and (r.text is None) == (x.doc_id in (1, None) and r.text is None))
            words = (text or "").encode().split()
            if prepare and x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 10 == 0 and words:
                h, n = zlib.crc32(str(x.doc_id).encode()), len(words)
                a = h // 10 % n
                p = 1 + (n - a) // (3 + h // 10 % 8)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            if x.doc_id is None:
                continue
            runs = brute_runs(words) if len(words) < 500 or len(set(words)) < 10 else [tuple(r) for r in x.runs]
            gone = {i for s, n, q in runs for i in range(s + q, s + n)}
            assert [tuple(r) for r in x.runs] == runs and x.n_runs == len(runs)
            assert x.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
            assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
            out[x.doc_id] = x
    assert (out[20].start, out[20].length, out[20].period, out[20].exponent_milli) == (0, 19, 2, 9500)
    assert out[1].n_runs == out[2].n_runs == 0 and out[1].start is None and out[1].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[13].n_runs == 1 and out[13].period == 3
    assert periodic_runs.run_report(nothing).count() == 0


def test_drop_repetitions(llm_spark, edge, nothing):
    got = periodic_runs.drop_repetitions(edge)
    assert got.columns == edge.columns and periodic_runs.drop_repetitions(nothing).count() == 0
    before, after = edge.orderBy("doc_id", "text").collect(), got.orderBy("doc_id", "text").collect()
    assert [r.text for r in after if r.doc_id == 13] == ["!!! ### $$$"]
    assert [tuple(r) for r in before if r.doc_id != 13] == [tuple(r) for r in after if r.doc_id != 13]


PAGE = """<!doctype html><html><head><title>Not this</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies.</div><!-- <p>no</p> -->
%s<aside>Other news</aside><form><p>Search</p><input value=">"></form><footer><p>&copy; Us</p></footer></body></html>"""


@pytest.mark.parametrize("body, want", [
    ("<article><header><h1>A &amp; B&nbsp; c</h1></header><p>One\n\t two<p>Three <b>four<br>five<p>x</article>", "A & B c\nOne two\nThree four five\nx"),
    ("<article><p>Text</p><div class='ad'><p>Buy</p></div><p>More&#33; &lt;b&gt;</p><section id=comments><article class=comment><p>Nice</p></article></section></article>", "Text\nMore! <b>"),
    ("<main><div><p>In main</p></div><div class=sidebar><p>Side</p></div></main><p>Outside</p>", "In main"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e  f\ng</pre><script>x</script><form>f</form></article>", "a\nb\nc\nd\ne f g"),
    ("<div class='x1'><h2>Heading</h2><p>" + "long text " * 20 + "</p><p>short</p></div><div><div><div><div>x</div></div></div></div>", "Heading\n" + ("long text " * 20).strip() + "\nshort"),
    ("<article><p>cut &amp</p><p>a &am</p><p>1 < 2 <p title='>'>q</p><p hidden>h</p><p style='display: none'>s</p><noscript>n</noscript></article>", "cut &\na &am\n1 < 2\nq"),
    ("", ""), ("<article></article>", ""),
])
def test_main_text(body, want):
    assert html_extract.main_text(PAGE % body) == want


def test_page_texts(llm_spark):
    long = "".join(f"<p>Paragraph {i} &amp; more.</p>" for i in range(20_000))
    pages = [(1, "u", None), (2, None, ""), (3, "u", "plain words only"), (4, "u", "<"), (5, "u", f"<article>{long}</article>"), (6, "u", "<article><p>cut off <b"), (6, "u", "<article><p>cut off <b"),
             (None, "u", "<nav>menu</nav><!-- open"), (7, "u", "<article><div class='ad'><p>x" + "</p>" * 3 + "\x00  y</div>z")]
    frame = llm_spark.createDataFrame([(*p, 1, "n") for p in pages], "page_id long, url string, html string, n_chars int, text string")
    got = sorted(html_extract.page_texts(frame).collect(), key=lambda r: (r.page_id or 0, r.text))
    texts = [(r.page_id, r.text) for r in got]
    assert texts[0] == (None, "") and texts[1:5] == [(1, ""), (2, ""), (3, "plain words only"), (4, "<")]
    assert got[5].text == "\n".join(f"Paragraph {i} & more." for i in range(20_000)) and got[5].n_chars == len(got[5].text)
    assert texts[6:8] == [(6, "cut off")] * 2 and texts[8] == (7, "z")
    assert html_extract.page_texts(frame.limit(0)).count() == 0
