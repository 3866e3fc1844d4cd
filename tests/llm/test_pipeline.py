import os

import corpus_pipeline
from brute import SF_SMALL, components, contamination, repeated_words
from llm_fixtures import edge, llm_spark, nothing  # noqa: F401  (fixtures)


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_against_brute_force(llm_spark):
    docs = llm_spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [(r.item_id, r.text) for r in llm_spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    toxic = {r.doc_id for r in llm_spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("toxic = 0").collect()}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["toxicity"](llm_spark, docs, SF_SMALL).cache()
    ids = {i for i, _ in _rows(one)}
    assert one.columns == docs.columns and toxic <= ids and len(ids) < docs.count()
    two = stages["near_duplicates"](llm_spark, one, SF_SMALL).cache()
    assert {i for i, _ in _rows(two)} == set(components(_rows(one), 5).values()) and two.columns == docs.columns
    three = stages["substring_dedup"](llm_spark, two, SF_SMALL).cache()
    rows = _rows(two)
    want = {i: t if not any(gone) else " ".join(w for w, g in zip(words, gone) if not g) for (i, t), (words, gone) in zip(rows, repeated_words(rows, 50))}
    assert dict(_rows(three)) == want and three.columns == docs.columns
    four = stages["decontaminate"](llm_spark, three, SF_SMALL).cache()
    rows = _rows(three)
    assert {i for i, _ in _rows(four)} == {i for (i, _), (n, h, _) in zip(rows, contamination(rows, items)) if not (h and 20 * h >= n)}
    assert not any(h for _, h, _ in contamination(_rows(four), items)) and four.columns == docs.columns
    five = stages["sentencepiece"](llm_spark, four, SF_SMALL)
    assert {r.doc_id for r in five.where("rank = 1").collect()} == {i for i, _ in _rows(four)}
    whole = corpus_pipeline.run(llm_spark, SF_SMALL)
    assert whole.columns == five.columns and whole.where("rank = 1").count() == four.count()


def test_stages_on_edges(llm_spark, edge, nothing):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (edge, nothing):
            out = stage(llm_spark, docs, SF_SMALL)
            assert out.count() >= 0 and (name == "sentencepiece" or out.columns == docs.columns)


def test_registered(llm_spark):
    import __spark_entry__ as entry
    names = [q for q in entry.queries() if q.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in entry.queries()
    assert os.path.exists(corpus_pipeline.__file__)
