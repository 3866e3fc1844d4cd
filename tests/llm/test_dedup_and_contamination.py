import hashlib

import pyarrow as pa
import pytest
from brute import SF_SMALL, SPACED, components, contamination, repeated_words
from llm_fixtures import edge, llm_spark, nothing  # noqa: F401  (fixtures)

from curasift.llm import decontaminate as dc
from curasift.llm import near_dup, substring_dedup


@pytest.fixture(scope="module")
def documents(llm_spark):
    return llm_spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def _key(t):
    return tuple((x is not None, x) for x in t)


def _removal(rows, width):
    out = []
    for (i, _), (w, gone) in zip(rows, repeated_words(rows, width)):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=_key)


@pytest.mark.parametrize("cells", [1 << 20, 1 << 26])  # a full sketch loses nothing either
def test_removal_report(edge, cells):
    got = sorted(map(tuple, substring_dedup.removal_report(edge, 50, cells).collect()), key=_key)
    assert got == _removal(_rows(edge), 50)


def test_removal_on_documents_with_short_windows(documents):
    got = sorted(map(tuple, substring_dedup.removal_report(documents, 8, 1 << 20).collect()), key=_key)
    assert got == _removal(_rows(documents), 8)


def test_remove_repeats_keeps_columns(edge, nothing):
    out = substring_dedup.remove_repeats(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    rows = {r.doc_id: r for r in out.collect() if r.doc_id}
    assert rows[6].text == "" and rows[6].n_chars == 0 and rows[6].n_words == "w"
    assert rows[7].text == "tail words here" and rows[5].text == {r.doc_id: r.text for r in edge.collect()}[5]
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_contamination(llm_spark, documents, edge, nothing):
    items = [(1, "thth erer onon " * 5), (2, None), (None, "One"), (3, ""), (3, "idiot"), (10, " ".join(SPACED.findall(edge.where("doc_id = 5").first().text)[20:60]).upper().replace("É", "é"))]
    bench = llm_spark.createDataFrame(items, "item_id long, text string")
    for docs, b in ((edge, items), (documents, [(r.item_id, r.text) for r in llm_spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()])):
        frame = bench if b is items else llm_spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
        rows = _rows(docs)
        want = sorted(((i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0 and 20 * h >= n) for (i, _), (n, h, x) in zip(rows, contamination(rows, b))), key=_key)
        assert sorted((tuple(r)[:6] for r in dc.contamination(docs, frame).collect()), key=_key) == want
        assert any(x[2] for x in want)
    assert dc.contamination(nothing, bench).count() == 0
    clean = dc.contamination(edge, bench.limit(0))
    assert clean.count() == edge.count() and clean.where("contaminated or n_hit > 0").count() == 0


def test_contamination_in_blocks(llm_spark, documents, monkeypatch):
    bench = llm_spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    whole = sorted(map(str, dc.contamination(documents, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_BYTES", 1000)
    assert len(list(dc._blocks(bench, 13))) > 2
    assert sorted(map(str, dc.contamination(documents, bench).collect())) == whole


def test_decontaminate_cuts_spans(llm_spark):
    phrase = " ".join(f"p{i}" for i in range(13))
    docs = llm_spark.createDataFrame([(1, "Head, " + phrase + "! " + "word " * 400, 5), (2, phrase, 5), (3, "clean", 5), (4, None, 5)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in dc.decontaminate(docs, llm_spark.createDataFrame([(1, phrase)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4} and out[1].text == "Head,! " + "word " * 400 and out[1].n_chars == len(out[1].text) and out[3].n_chars == 5


def test_fm_index_against_search():
    import numpy as np
    r = np.random.default_rng(0)
    text = r.integers(0, 4, 500)
    index = dc.FMIndex(text, 3)
    patterns = np.array([p for p in np.unique(r.integers(1, 4, (60, 3)), axis=0)])
    which, lo, hi = index.search(patterns)
    got = {tuple(patterns[w]): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi)}
    want = {}
    for i in range(len(text) - 2):
        if text[i:i + 3].all():
            want.setdefault(tuple(text[i:i + 3]), []).append(i)
    assert got == {k: v for k, v in want.items() if any((patterns == k).all(axis=1))}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(documents, size):
    rows = _rows(documents)
    want = components(rows, size)
    got = {r.doc_id: r for r in near_dup.near_duplicates(documents, size).collect()}
    assert {i: r.component_id for i, r in got.items()} == want and len(set(want.values())) < len(want)
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_near_duplicate_chain_across_blocks(llm_spark, monkeypatch):
    """Links between members that are not the leader's, over several blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    import random
    r, words, rows = random.Random(3), [f"w{i}" for i in range(100)], []
    for i in range(40):
        rows.append((i, " ".join(words)))
        for _ in range(4):
            words[r.randrange(100)] = f"n{i}x{r.random()}"
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in near_dup.near_duplicates(docs, 1).collect()} == components(rows, 1)


@pytest.mark.parametrize("n, shuffled", [(1000, False), (120, True)])
def test_components_of_a_long_chain(llm_spark, n, shuffled):
    """A chain takes a number of rounds in the logarithm of its length."""
    import math
    import random
    ids = list(range(n))
    if shuffled:
        random.Random(1).shuffle(ids)
    links = llm_spark.createDataFrame([*zip(ids, ids[1:], strict=False), (2000, 2001), (2001, 2000), (3000, 3000)], "a long, b long")
    rounds = []
    got = {r.node: r.component for r in near_dup.components(links, rounds).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 2000: 2000, 2001: 2000}
    assert len(rounds) <= 2 * math.log2(n) and max(rounds) <= math.log2(n) + 2


def test_near_duplicates_of_repeated_rows(llm_spark):
    """An id that occurs very often is compared once for each of its rows, not for each pair of them."""
    words = [f"w{i}" for i in range(100)]
    near = [*words[:78], *(f"x{i}" for i in range(22))]
    rows = [(1, " ".join(words))] + [(2, " ".join(near))] * 3000 + [(3, " ".join(words[:90] + near[90:]))]
    got = near_dup.near_duplicates(llm_spark.createDataFrame(rows, "doc_id long, text string"), 1).groupBy("doc_id", "component_id").count().collect()
    assert {(r.doc_id, r.component_id, r["count"]) for r in got} == {(i, c, n) for (i, c), n in zip(sorted(components([rows[0], rows[1], rows[-1]], 1).items()), (1, 3000, 1), strict=True)}


def test_near_duplicates_edges(edge, nothing):
    rows = near_dup.near_duplicates(edge, 2).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[6].component_id == by[7].component_id == by[11].component_id == 5 and not by[6].kept and by[1].n_shingles == 0
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    kept = near_dup.drop_near_duplicates(edge, 2)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 8, 9, 10, 12, 13, 14}
    assert near_dup.near_duplicates(nothing, 2).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_shingles_of_slices_of_few_words(size):
    """Slices that hold fewer words than a shingle."""
    for n in range(7):
        for texts in ([" ".join("abcdef"[:n])], [None, " ".join("ABCDEF"[:n]), ""]):
            sets = near_dup.shingle_sets(pa.array(texts, pa.string()), size)
            assert [len(s) for s in sets] == [max(n - size + 1, min(n, 1)) if t else 0 for t in texts]


def test_near_duplicates_of_a_short_text_between_long_ones(llm_spark):
    """Documents of over a slice make the short text a slice of its own."""
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, long), (2, "two words"), (3, long + " end"), (4, "Two  words"), (5, "x y z")]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, 5).collect()}
    assert len(long) > 2 << 20 and got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}


def test_columns_named_like_the_operators_own(llm_spark):
    """Extra columns keep their values whatever their names; only text and n_chars change."""
    base, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    names = ["_hit", "_n", "_items", "_text", "_kept", "_starts", "_packed", "_text_key", "_doc", "_key", "_gone", "gone", "row", "n_shingles", "a.b"]
    rows = [(1, base, 5, *(f"{n}1" for n in names)), (2, other + " " + base, 6, *(f"{n}2" for n in names)), (3, base, None, *(f"{n}3" for n in names))]
    docs = llm_spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "n_chars long", *(f"`{n}` string" for n in names)]))
    items = llm_spark.createDataFrame([("i", " ".join(f"v{i}" for i in range(13)))], "item_id string, text string")
    own = lambda df: {r.doc_id: tuple(r)[3:] for r in df.collect()}
    want = {r[0]: r[3:] for r in rows}
    cut = substring_dedup.remove_repeats(docs, 50)
    assert cut.columns == docs.columns and own(cut) == want and {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == {1: (base, 5), 2: (other, len(other)), 3: ("", 0)}
    clean = dc.decontaminate(docs, items, percent=50)
    assert clean.columns == docs.columns and own(clean) == want
    assert {r.doc_id: r.n_chars for r in clean.collect()}[2] == len(other + " " + base) - len(" ".join(f"v{i}" for i in range(13)))
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and own(left) == {i: want[i] for i in (1, 2)}


def test_near_duplicate_texts_are_shuffled_packed():
    import pyarrow as pa
    texts = ["word " * 5000, None, "", "\u00e9\u6587 a", "x" * 70, "word " * 3000]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(6), pa.int64()), "text": pa.array(texts)})
    packed = list(near_dup._packed(iter([batch])))
    assert sum(len(t or b"") for b in packed for t in b.column(1).to_pylist()) < 1000
    back = list(near_dup._unpacked(iter(packed), 15_000))
    assert len(back) == 3 and [x for b in back for x in zip(*(c.to_pylist() for c in b.columns), strict=True)] == list(enumerate(texts))
