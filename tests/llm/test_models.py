import numpy as np
import pyarrow as pa
import pytest
from brute import SF_SMALL, base_scores, text_statistics
from llm_fixtures import edge, llm_spark, nothing  # noqa: F401  (fixtures)

from curasift.llm import lm_score, quality_rules, subword, toxicity
from curasift.llm.common import column, slices

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(llm_spark):
    return llm_spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(llm_spark):
    return llm_spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_on_unseen_labels(llm_spark):
    documents, labels = (llm_spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(documents, labels.where("doc_id % 3 <> 0"))
    assert (np.diff(model.theta) > 0).all()
    got = toxicity.severity(documents, model).join(labels.where("doc_id % 3 = 0").select("doc_id", labels.toxic.alias("y")), "doc_id").toPandas()
    assert got.toxic[got.y == 0].mean() < 0.005 and got.toxic[got.y == 1].mean() > 0.85
    assert got.expected_severity[got.y == 1].mean() > 10 * got.expected_severity[got.y == 0].mean()


def test_toxicity_edges(llm_spark, edge, nothing):
    marks = llm_spark.createDataFrame([(12, 1), (5, 0), (None, 1), (8, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edge, marks)
    assert toxicity.severity(edge, model).count() == edge.count() and toxicity.severity(nothing, model).count() == 0
    one = toxicity.fit(edge, marks.where("toxic = 0"))
    assert toxicity.drop_toxic(edge, one).columns == edge.columns and toxicity.drop_toxic(edge, one).count() == edge.count()


def test_statistics(llm_spark, edge):
    docs = llm_spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text").where("doc_id is not null")).distinct()
    own = {(r.doc_id, r.text): text_statistics(r.text) for r in docs.collect()}
    got = quality_rules.statistics(docs).collect()
    want = sorted((k[0], *v) for k, v in own.items())
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_quality_rules(llm_spark, documents, labels, edge, nothing):
    rules = quality_rules.learn(documents, labels.where("doc_id % 3 <> 0"))
    assert rules
    got = quality_rules.judge(documents, rules).join(labels.where("doc_id % 3 = 0").select("doc_id", "quality"), "doc_id").toPandas()
    good = got[(got.quality == 1) & ~got.base_failed]
    assert good.kept.mean() > 0.97 and (~got.kept[got.quality == 0]).mean() > 0.5
    assert quality_rules.judge(edge, rules).count() == edge.count() and quality_rules.judge(nothing, rules).count() == 0
    assert quality_rules.learn(documents, labels.limit(0)) == []
    assert quality_rules.judge(edge, []).where("kept = base_failed").count() == 0


def test_quality_rules_filtered(llm_spark):
    """A filter on the result computes no statistic twice, whatever a text's length."""
    from llm_fixtures import prose
    docs = llm_spark.createDataFrame([(1, prose(2, 30_000)), (2, "too few words"), (3, None)], "doc_id long, text string")
    rules = [(quality_rules.Condition("repeat_share", True, 0.4), quality_rules.Condition("mean_word", False, 3.0)), (quality_rules.Condition("symbol_share", True, 0.2),)]
    kept = quality_rules.judge(docs, rules).where("kept and n_words > 10")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") <= quality_rules.judge(docs, rules)._jdf.queryExecution().optimizedPlan().toString().count("sort_array") <= 4
    assert {r.doc_id for r in kept.collect()} <= {1} and quality_rules.judge(docs, rules).where("not kept").count() >= 2


def test_lm_gradient():
    r = np.random.default_rng(0)
    flat = r.standard_normal(lm_score._SIZE) * 0.3
    x, y = (r.integers(0, lm_score.CLASSES, (3, lm_score.WINDOW)) for _ in range(2))
    live = r.random(x.shape) < 0.8
    loss = lambda f: lm_score._gradient(lm_score._params(f), x, y, live)[0] / live.sum()
    _, g = lm_score._gradient(lm_score._params(flat), x, y, live)
    for i in [*r.integers(0, len(flat), 10), int(abs(g).argmax())]:
        e = np.zeros_like(flat)
        e[i] = 1e-5
        assert abs((loss(flat + e) - loss(flat - e)) / 2e-5 - g[i]) < 1e-6


def test_lm_windows_score_each_token_once():
    """A window's scores are those of a forward pass over its own inputs alone."""
    r = np.random.default_rng(1)
    bounds = np.r_[0, np.cumsum([1, 31, 32, 33, 150])]
    classes = r.integers(0, lm_score.HEAD, bounds[-1]).astype(np.int32)
    model = lm_score.Model(None, None, None, (r.standard_normal(lm_score._SIZE) * 0.3).astype(np.float32))
    got = lm_score.log_probabilities(model, bounds, classes, batch=3)
    w, seen = lm_score._params(model.weights), np.zeros(len(classes), int)
    for a, b in zip(bounds[:-1], bounds[1:]):
        x = np.r_[lm_score.BEGIN, classes[a:b - 1]]
        for f in range(0, max(1, b - a - lm_score.WINDOW + lm_score.STRIDE), lm_score.STRIDE):
            part = x[f:f + lm_score.WINDOW]
            logs = lm_score.log_likelihood(w, lm_score.forward(w, part[None])[0], classes[a + f:a + f + len(part)])
            new = slice(0 if f == 0 else lm_score.WINDOW - lm_score.STRIDE, None)
            at = np.arange(a + f, a + f + len(part))[new]
            assert np.allclose(got[at], logs[new], atol=1e-4)
            seen[at] += 1
    assert (seen == 1).all()


def test_lm_scores(llm_spark, documents, edge, nothing):
    docs = documents.unionByName(edge.select(documents.columns))
    scorer = lm_score.fit(docs, rounds=1)
    got = lm_score.score(docs, scorer).toPandas()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, n = base_scores(rows)
    key = lambda t: (t[0] is not None, *t)
    a = sorted(((None if np.isnan(r.doc_id) else int(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got.itertuples()), key=key)
    b = sorted(((i, *x[:2], round(x[2], 5)) for (i, _), x in zip(rows, want)), key=key)
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b], rtol=1e-9) and (got.train_tokens == n).all()
    held = got[got.held_out]
    start = lm_score.Scorer(lm_score.Model(scorer.model.vocabulary, scorer.model.class_of, scorer.model.share, lm_score.initial(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES))), scorer.counts, scorer.tokens, scorer.distinct, scorer.ends)
    plain = lm_score.score(docs, start).toPandas()
    assert held.score.sum() > 0.75 * plain[plain.held_out].score.sum() and (got.score < 0).all()
    empty = lm_score.score(nothing, lm_score.fit(nothing))
    assert empty.count() == 0


def test_hot_words_and_the_join_agree(llm_spark, monkeypatch):
    docs = llm_spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    scorer = lm_score.fit(docs, rounds=0)
    whole = lm_score.score(docs, scorer).toPandas().sort_values("doc_id")
    monkeypatch.setattr(lm_score, "HOT", 5)
    few = lm_score.score(docs, scorer).toPandas().sort_values("doc_id")
    assert (whole.n_known.values == few.n_known.values).all() and np.allclose(whole.base_score, few.base_score)


@pytest.fixture(scope="module")
def vocabulary():
    return subword.Vocabulary.load()


def test_segmentations_are_gumbel_top_k(vocabulary):
    text, pieces = "thehe on", {p: i for i, p in enumerate(vocabulary.pieces) if p and i not in vocabulary.byte_ids}

    def all_of(raw):
        return [()] if not raw else [(pieces[raw[:n]], *rest) for n in range(1, len(raw) + 1) if raw[:n] in pieces for rest in all_of(raw[n:])]

    ways = all_of(b" " + text.encode())
    logs = np.array([vocabulary.log_weight[list(s)].sum() for s in ways])
    logs -= np.logaddexp.reduce(logs)
    place, p, n = {s: i for i, s in enumerate(ways)}, np.exp(logs), 20_000
    first, second, total = np.zeros(len(ways)), np.zeros(len(ways)), 0.0
    for found in subword.sample_slice(pa.array([text] * n), np.arange(n), vocabulary, 2):
        i, j = (place[tuple(s.ids)] for s in found)
        assert i != j and found[0].value > found[1].value and abs(found[0].log_prob - logs[i]) < 1e-9
        first[i] += 1
        second[j] += 1
        total += sum(p[k] / s.inclusion for k, s in zip((i, j), found))
    after = np.array([sum(p[j] * p[i] / (1 - p[j]) for j in range(len(p)) if j != i) for i in range(len(p))])
    assert np.abs(first / n - p).max() < 0.01 and np.abs(second / n - after).max() < 0.01 and abs(total / n - 1) < 0.01


def test_all_segmentations_of_a_short_text(vocabulary):
    found = subword.sample_slice(pa.array(["hi", "", None]), np.array([1, 2, 3]), vocabulary, 50)
    assert len({tuple(s.ids) for s in found[0]}) == len(found[0]) < 50 and all(s.inclusion == 1 for s in found[0])
    assert abs(sum(np.exp(s.log_prob) for s in found[0]) - 1) < 1e-9
    assert [len(x) for x in found[1:]] == [1, 1] and not len(found[1][0].ids)


def test_held_lattices_stay_small(vocabulary):
    """What a worker holds over its slices, however many distinct units they bring."""
    rng, lattice, most = np.random.default_rng(5), subword.Lattice(vocabulary), 0
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz      "))
    texts = ["".join(letters[rng.integers(0, 32, 1 << 16)]) for _ in range(56)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "doc_id": pa.array(range(len(texts)))})
    for part in slices(iter([batch]), max_bytes=subword.SLICE):
        found = subword.sample_slice(column(part, "text"), np.arange(part.num_rows), vocabulary, 1, lattice)
        assert len(found) == part.num_rows
        most = max(most, sum(x.nbytes for x in vars(lattice).values() if isinstance(x, np.ndarray)))
    assert 0 < most < 120 << 20


def test_lattices_held_over_slices(vocabulary, monkeypatch):
    """Samples don't depend on the units that a task has seen before, or let go."""
    texts = [pa.array(x) for x in (["one two  two", "", "Straße ☃☃"], ["two three", None, "x" * 3000], ["one\x00 two ☃", "three  two"])]
    draw = lambda i, lattice=None: [[(*s.ids, s.log_prob, s.value, s.inclusion) for s in found] for found in subword.sample_slice(texts[i], np.arange(len(texts[i])), vocabulary, 3, lattice)]
    alone = [draw(i) for i in range(3)]
    held = subword.Lattice(vocabulary)
    assert [draw(i, held) for i in range(3)] == alone and len(held.keys) == len(set(held.keys))
    assert (np.diff(held.heads[np.argsort(held.heads)]) > 0).all() and [draw(i, held) for i in (2, 0, 1)] == [alone[2], alone[0], alone[1]]
    monkeypatch.setattr(subword, "HELD", 10)
    few = subword.Lattice(vocabulary)
    assert [draw(i, few) for i in (0, 1, 2, 1)] == [*alone, alone[1]]


def test_round_trip_and_partitions(llm_spark, documents, edge, nothing, vocabulary):
    docs = documents.unionByName(edge.select(documents.columns))
    report = subword.encoding_report(docs, vocabulary, 3).cache()
    assert report.where("not restored").count() == 0 and report.where("rank = 1").count() == docs.count()
    again = subword.encoding_report(docs.repartition(7), vocabulary, 3)
    assert sorted(map(str, report.drop("log_prob", "perturbed", "inclusion").collect())) == sorted(map(str, again.drop("log_prob", "perturbed", "inclusion").collect()))
    encoded = subword.sample_encodings(edge, vocabulary, 1)
    back = subword.decode(encoded, vocabulary)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((r.doc_id or 0, r.text or "") for r in edge.collect())
    assert subword.sample_encodings(nothing, vocabulary).count() == 0


@pytest.mark.parametrize("least", [0, 1_500_000])
def test_lm_rounds_cover_all_training_documents(llm_spark, documents, edge, monkeypatch, least):
    """Once each in a large corpus, and in every round in a small one."""
    monkeypatch.setattr(lm_score, "LEAST_WORDS", least)
    docs = documents.unionByName(edge.select(documents.columns))
    rounds = []
    monkeypatch.setattr(lm_score, "_averaged", lambda part, model, number, rate: (rounds.append([(r.doc_id, r.text) for r in part.collect()]), model.weights)[1])
    lm_score.fit(docs)
    key = lambda t: (t[0] is not None, t[0] or 0, t[1] or "")
    known = [(r.doc_id, r.text) for r in docs.where(~lm_score.held_out()).collect()]
    assert len(rounds) == lm_score.ROUNDS and all(rounds)
    assert sorted((x for part in rounds for x in part), key=key) == sorted(known * (lm_score.ROUNDS if least else 1), key=key)


def test_lm_steps_cover_all_windows(monkeypatch):
    r = np.random.default_rng(5)
    bounds = np.r_[0, np.cumsum(r.integers(1, 60, 20_000))]
    classes = r.integers(0, lm_score.HEAD, bounds[-1]).astype(np.int32)
    model, seen = lm_score.Model(None, None, None, lm_score.initial(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES))), set()

    def inputs(bounds, classes, text, first):
        seen.update(zip(text.tolist(), first.tolist()))
        z = np.zeros((1, 1), np.int64)
        return z, z, z == 0

    monkeypatch.setattr(lm_score, "_inputs", inputs)
    lm_score.train(model, bounds, classes, 0, lm_score.steps_over(bounds), 0.01)
    assert seen == set(zip(*(x.tolist() for x in lm_score._windows(bounds))))


def test_lm_pass_trains_on_each_token_once():
    r = np.random.default_rng(6)
    bounds = np.r_[0, np.cumsum(r.integers(1, 150, 1_000))]
    classes = r.integers(0, lm_score.HEAD, bounds[-1]).astype(np.int32)
    model = lm_score.Model(None, None, None, lm_score.initial(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES)))
    steps = -(-len(lm_score._windows(bounds)[0]) // lm_score.BATCH)
    weights, trained = lm_score.train(model, bounds, classes, 0, steps, 0.01)
    assert trained == bounds[-1] and np.isfinite(weights).all()


def test_lm_extreme_scores():
    """Attention and softmax where exp would overflow or vanish."""
    r = np.random.default_rng(7)
    asks, keys = (r.standard_normal((2, lm_score.WINDOW, lm_score.WIDTH)) for _ in range(2))
    for scale in (1, 40):
        a = asks @ keys.transpose(0, 2, 1) * scale - 100 * (scale - 1)
        a = np.where(np.tril(np.ones(a.shape[1:], bool)), a, -np.inf)
        want = np.exp(a - a.max(axis=2, keepdims=True))
        want /= want.sum(axis=2, keepdims=True)
        moved = np.concatenate([asks * scale, np.full((*asks.shape[:2], 1), -100.0 * (scale - 1))], axis=2)
        got = lm_score._attention(moved, np.concatenate([keys, np.ones((*keys.shape[:2], 1))], axis=2))
        assert np.allclose(got, want, atol=1e-6)
        logits = r.standard_normal((50, 32)) * scale - 100 * (scale - 1)
        want = np.exp(logits - logits.max(axis=1, keepdims=True))
        assert np.allclose(lm_score._softmax(logits.copy()), want / want.sum(axis=1, keepdims=True))


def test_short_beginnings_are_not_searched_for(vocabulary, monkeypatch):
    one, two = vocabulary.short()
    begin = {raw[:n] for i, raw in enumerate(vocabulary.pieces) if i not in set(vocabulary.byte_ids.tolist()) for n in (1, 2) if len(raw) >= n}
    assert {bytes([i]) for i in np.flatnonzero(one >= 0)} | {bytes(divmod(int(i), 256)) for i in np.flatnonzero(two >= 0)} == begin
    monkeypatch.setattr(subword.Vocabulary, "find", lambda *_: pytest.fail("searched"))
    found = subword.sample_slice(pa.array(["a b \x00 c"]), np.array([1]), vocabulary, 2)
    assert [vocabulary.decode(s.ids) for s in found[0]] == ["a b \x00 c"] * 2


def test_lm_sequences_of_known_distinct_words():
    """Scoring looks for the distinct words of a slice once, for its counts and its pieces."""
    vocabulary = subword.Vocabulary.load(subword.MODEL)
    r = np.random.default_rng(9)
    size = len(vocabulary.pieces)
    model = lm_score.Model(vocabulary, r.integers(0, lm_score.HEAD, size).astype(np.int32), r.standard_normal(size), None)
    for texts in (["the cat and the hat, The END", None, "", "the été été", "\x00 \U0001f600"], [None, ""]):
        found = lm_score.words(pa.array(texts, pa.string()), lm_score.SPACES, lower=True)
        h, where, unit = lm_score.distinct(found)
        want_h, want_unit = np.unique(found.hashes(), return_inverse=True)
        assert np.array_equal(h, want_h) and np.array_equal(unit, want_unit) and np.array_equal(found.hashes()[where], h)
        got, want = model.sequences(found, len(texts), (where, unit)), model.sequences(found, len(texts))
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True)) and len(got[0]) == len(texts) + 1
