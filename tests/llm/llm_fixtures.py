import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns with the names of operators' own
    T.StructField("n_words", T.StringType()), T.StructField("kept", T.LongType()), T.StructField("shard", T.StringType()), T.StructField("_hit", T.StringType())])


def prose(seed: int, n: int) -> str:
    import random
    r = random.Random(seed)
    return " ".join("".join(r.choice(("th", "er", "on", "an", "re", "ché", "ß")) for _ in range(r.randint(1, 4))) for _ in range(n))


def edge_rows() -> list[tuple]:
    base = prose(1, 120)
    texts = {1: None, 2: "", 3: " \t\n ", 4: "One", 5: base, 6: base, 7: base + " tail words here", 8: prose(2, 30_000), 9: "x" * 50_000,
             10: "a\x00b \u2581 \U0001F600 é", 11: base.translate({c: c - 32 for c in range(0x61, 0x7B)}), 12: "idiot " + prose(3, 80), 13: "!!! ### $$$ " * 40, 14: prose(4, 20) + " " + " ".join(base.split()[10:80])}
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    rows += [(None, base, None, None, None), (None, None, None, None, None), (6, base, "en", "s", len(base)), (6, base, "en", "s", len(base))]
    return [(*r, "w", 7, "x", "y") for r in rows]


@pytest.fixture(scope="session")
def llm_spark(spark):
    from curasift.llm.common import ship_package
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def edge(llm_spark):
    return llm_spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="session")
def nothing(llm_spark):
    return llm_spark.createDataFrame([], DOCS)
