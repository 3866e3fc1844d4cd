"""Toxicity as severity grades, by cumulative-link ordinal regression.

Features are the distinct words of a text (letters and digits, A-Z lower-cased) and their
first 4 and 5 bytes, which carry over to unseen endings; those are kept whose share of documents
differs between the classes by ``SIGNIFICANT`` standard errors.  Grades come
from the labels: unlabelled severity is graded from what sets toxic documents apart.  For the
labelled rows, word statistics (documents with the word in either class, as one Spark
aggregation) give the words that lean to the toxic class; a toxic document's grade is 1, 2 or 3
by how many such words it has, a clean document's is 0.

The model is ``P(grade <= k) = sigmoid(theta_k - w . x)``: one weight vector shared by all
thresholds, theta increasing.  It is fitted on at most ``sample`` labelled rows, those with the
smallest hash of their id, so their ids can be broadcast and no text is shuffled; the gradient
steps, with an L2 penalty, run on the driver.  A document's expected severity is the sum of
``P(grade > k)``; it is toxic if ``P(grade > 0)`` reaches 0.5.

Defined results: null and empty texts have no features and get the model's base rate; labels
that are null, or whose document is missing, are ignored; without both classes nothing is
toxic and all severities are 0; repeated rows are judged alike."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curasift.llm.common import NON_ALNUM, Words, column, cut_lineage, mix, signed, slices, words

#: Most labelled rows to fit on, most words in the model, and grades above 0.
SAMPLE = 20_000
#: Standard errors by which a word's share must differ between the classes to be a feature; beyond
#: what chance brings among some hundred thousand words.
SIGNIFICANT = 5.0
#: Least distance of two thresholds.
LEAST_GAP = 0.01
WORDS = 4_096
GRADES = 3


@dataclass
class OrdinalModel:
    hashes: np.ndarray   # sorted word hashes
    weights: np.ndarray
    theta: np.ndarray    # increasing thresholds

    def score(self, texts: pa.Array) -> np.ndarray:
        """w . x of each text: the sum of the weights of its distinct known words."""
        doc, word = word_sets(texts, self.hashes)
        return np.bincount(doc, self.weights[word], minlength=len(texts)) if len(self.hashes) else np.zeros(len(texts))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - score[:, None], -40, 40)))


def _terms(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word, and of the beginnings of longer words."""
    h, doc = [found.hashes()], [found.docs()]
    for n in (4, 5):
        long = np.flatnonzero(found.ends - found.starts > n)
        part = Words(found.data, found.bounds, found.starts[long], found.starts[long] + n, found.offsets)
        h.append(mix(part.hashes() + np.uint64(n)))
        doc.append(doc[0][long])
    return np.concatenate(h), np.concatenate(doc)


def word_sets(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place of the word in ``known``) pairs."""
    h, doc = _terms(words(texts, NON_ALNUM, lower=True))
    if not len(known) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = np.flatnonzero(known[place] == h)
    pairs = np.unique(doc[hit] * np.int64(len(known)) + place[hit])
    return pairs // len(known), pairs % len(known)


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, toxic of at most ``sample`` labelled ids."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = marks.withColumn("_u", F.xxhash64("doc_id")).orderBy("_u", "doc_id").limit(sample).drop("_u")
    return docs.select("doc_id", "text").join(F.broadcast(cut_lineage(picked)), "doc_id")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        h, doc = _terms(words(column(batch, "text"), NON_ALNUM, lower=True))
        toxic = column(batch, "toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
        h, doc = h[new], doc[new]
        word, at = np.unique(h, return_inverse=True)
        yield pa.RecordBatch.from_pydict({"word": pa.array(signed(word)), "n0": pa.array(np.bincount(at, toxic[doc] == 0, len(word)).astype(np.int64)), "n1": pa.array(np.bincount(at, toxic[doc] > 0, len(word)).astype(np.int64))})


def _design(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, word = word_sets(column(batch, "text"), known)
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_pydict({"toxic": column(batch, "toxic").cast(pa.int32()), "words": pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(word.astype(np.int32)))})

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_words: int = WORDS, steps: int = 400, penalty: float = 0.1) -> OrdinalModel:
    rows = _labelled(docs, labels, sample)
    sizes = {x.t: x.n for x in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, 40.0))
    counts = rows.mapInArrow(_counts, "word long, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
    # words whose share of documents differs most between the classes (signed chi-square)
    p1, p0 = F.col("c1") / F.lit(n1), F.col("c0") / F.lit(n0)
    p = (F.col("c1") + F.col("c0")) / F.lit(n1 + n0)
    z = (p1 - p0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * F.lit(1 / n1 + 1 / n0))
    top = counts.select("word", z.alias("z")).where(F.abs("z") >= SIGNIFICANT)
    best = top.orderBy(F.abs("z").desc(), "word").limit(n_words).collect()
    hashes = np.array([x.word for x in best], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    known = hashes[order]
    telling = np.array([x.z > 0 for x in best], bool)[order]
    data = rows.select("toxic", "text").mapInArrow(_design(known), "toxic int, words array<int>").toArrow()
    lists = data["words"].combine_chunks()
    word = lists.flatten().to_numpy()
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    toxic = data["toxic"].to_numpy() > 0
    marks = np.bincount(doc, telling[word], len(toxic))
    grade = np.where(toxic, np.clip(np.digitize(marks, np.quantile(marks[toxic], [1 / 3, 2 / 3])) + 1, 1, GRADES) if toxic.any() else 0, 0)
    weights, theta = _regress(doc, word, grade, len(known), steps, penalty)
    return OrdinalModel(known, weights, theta)


def _regress(doc: np.ndarray, word: np.ndarray, grade: np.ndarray, n_words: int, steps: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Adam steps on the penalized likelihood; thresholds are a first one and log gaps."""
    n = len(grade)
    rate = np.clip([(grade > k).mean() for k in range(GRADES)], 1e-3, 1 - 1e-3)
    cut = np.log((1 - rate) / rate)
    x = np.r_[np.zeros(n_words), cut[0], np.log(np.maximum(np.diff(cut), 0.05))]
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        w, gaps = x[:n_words], np.exp(x[n_words + 1:])
        theta = np.r_[x[n_words], x[n_words] + np.cumsum(LEAST_GAP + gaps)]
        s = np.bincount(doc, w[word], minlength=n)
        low = np.where(grade > 0, 1 / (1 + np.exp(np.clip(s - np.r_[0, theta][grade], -40, 40))), 0)
        high = np.where(grade < GRADES, 1 / (1 + np.exp(np.clip(s - np.r_[theta, 0][grade], -40, 40))), 1)
        p = np.maximum(high - low, 1e-9)
        d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
        d_s = d_high - d_low                                     # of the loss, by s
        d_theta = np.array([(d_low[grade == k + 1].sum() - d_high[grade == k].sum()) for k in range(GRADES)])
        g = np.r_[np.bincount(word, d_s[doc], minlength=n_words) + penalty * w, d_theta.sum(), [d_theta[k + 1:].sum() * gaps[k] for k in range(GRADES - 1)]] / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x[:n_words], np.r_[x[n_words], x[n_words] + np.cumsum(LEAST_GAP + np.exp(x[n_words + 1:]))]


def severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_severity, grade (the most likely), p_toxic, toxic, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            above = shared.value.above(shared.value.score(column(batch, "text")))
            each = np.c_[np.ones(len(above)), above] - np.c_[above, np.zeros(len(above))]
            toxic = above[:, 0] >= 0.5
            yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id"), "expected_severity": pa.array(above.sum(axis=1)), "grade": pa.array(each.argmax(axis=1).astype(np.int32)), "p_toxic": pa.array(above[:, 0]), "toxic": pa.array(toxic), "kept": pa.array(~toxic)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean, kept boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows and columns of ``docs`` that are not toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            above = shared.value.above(shared.value.score(column(batch, "text")))
            yield batch.filter(pa.array(above[:, 0] < 0.5))

    return docs.mapInArrow(run, docs.schema)
