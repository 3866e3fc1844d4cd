"""Quality rules learned as a decision list over text statistics.

The statistics of a text are built-in expressions.  On a bounded sample of labelled documents
(``sample`` rows, those with the smallest hash of their id) sequential covering learns rules
for the rejected class: a rule grows by the threshold condition with the best information gain
on the growing part until it covers no good document, is pruned from its end on the pruning
part, and is kept if it is precise enough there; the rows it covers are taken away and the
next rule grows.  Thresholds are quantiles of the sample; each step is one small aggregation
over (feature, bin).  The result is an ordered ``CASE WHEN`` expression.

Defined results: null and empty texts have all counts 0; labels that are null or repeat are
taken as rejected if any says so; without labels of both classes the list is empty and keeps
all; repeated rows are judged alike."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curasift.llm.common import cut_lineage

#: Most labelled rows to learn from, thresholds for each feature, most rules and conditions.
SAMPLE, THRESHOLDS, RULES, CONDITIONS = 20_000, 32, 12, 4
#: Least share of rejected documents among those a rule covers, and least number covered.
PRECISION, SUPPORT = 0.95, 5
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "words_a_line")
_SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", text.alias("t")).select(
        "doc_id", F.filter(F.split("t", _SPACE), lambda w: w != "").alias("w"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    last = F.size("w") - 3
    grams = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(F.xxhash64(F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2]).alias("g"), i.alias("i"))))
    ordered = split.select("doc_id", "n_symbols", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                           F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.sort_array(grams).alias("s"))
    same = lambda a, b: F.col("s")[a]["g"] == F.col("s")[b]["g"]
    end = F.size("s") - 1
    twice = F.filter(F.sequence(F.lit(0), F.greatest(end, F.lit(0))), lambda k: ((k > 0) & F.when(k > 0, same(k - 1, k))) | ((k < end) & F.when(k < end, same(k, k + 1))))
    places = F.when(F.size("s") > 1, F.sort_array(F.transform(twice, lambda k: F.col("s")[k]["i"])))
    found = ordered.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", places.alias("p"))
    more = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), F.lit(3), lambda acc, k: acc + F.when(k < F.size("p"), F.least(F.lit(3), F.col("p")[k] - F.col("p")[k - 1])).otherwise(0))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.size("p") > 0, more).otherwise(0).cast("long").alias("n_repeat_words"))


def features() -> dict[str, Column]:
    """The features of a decision list from the columns of ``statistics``; 0 for no words."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"n_words": F.col("n_words").cast("double"), "mean_word": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "words_a_line": share("n_words", "n_lines")}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.col(self.feature)
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _all(rule: Sequence[Condition]) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def _counts(rows: DataFrame, column: Column) -> tuple[int, int]:
    bad, n = rows.where(column).agg(F.coalesce(F.sum("bad"), F.lit(0)), F.count(F.lit(1))).first()
    return bad, n - bad


def _best(rows: DataFrame, rule: Rule, cuts: dict[str, list[float]]) -> tuple[Condition | None, int]:
    """The condition with the best gain, and how many good rows stay covered with it."""
    number = lambda f: reduce(lambda a, c: a + F.when(F.col(f) > c, 1).otherwise(0), cuts[f], F.lit(0))
    bins = F.array(*[F.struct(F.lit(f).alias("f"), number(f).alias("b")) for f in FEATURES if cuts[f]])
    table = rows.where(_all(rule)).select("bad", F.explode(bins).alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    p0 = sum(x.bad for x in table if x.f == FEATURES[0])
    n0 = sum(x.n for x in table if x.f == FEATURES[0]) - p0
    best, gain, left = None, 1e-9, n0
    if not p0:
        return None, n0
    for f in FEATURES:
        for i, cut in enumerate(cuts[f]):
            for above in (False, True):
                own = [x for x in table if x.f == f and (x.b > i) == above]
                p = sum(x.bad for x in own)
                n = sum(x.n for x in own) - p
                if p and p + n < p0 + n0:
                    g = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    if g > gain:
                        best, gain, left = Condition(f, above, cut), g, n
    return best, left


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Ordered rules for documents to reject; ``labels`` has doc_id and quality (0: reject)."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("bad"))
    drawn = marks.withColumn("u", F.xxhash64("doc_id")).orderBy("u", "doc_id").limit(sample).drop("u")
    stats = statistics(docs.select("doc_id", "text").join(drawn.select("doc_id"), "doc_id", "left_semi"))
    kinds = features()
    rows = cut_lineage(stats.join(drawn, "doc_id").select("bad", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("prune"), *[c.alias(f) for f, c in kinds.items()]))
    both = rows.agg(F.sum("bad"), F.count(F.lit(1))).first()
    if not both[1] or not 0 < both[0] < both[1]:
        return []
    # quantiles of either class, so that a rare class has thresholds of its own
    points = [i / THRESHOLDS for i in range(1, THRESHOLDS)]
    found = [rows.where(F.col("bad") == y).agg(*[F.percentile(f, F.lit(points)).alias(f) for f in FEATURES]).first() for y in (0, 1)]
    ends = rows.where("bad = 0").agg(*[F.array(F.min(f), F.max(f)).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted({*(x for row in found for x in row[f]), *ends[f]}) for f in FEATURES}
    grow, prune = rows.where("not prune"), rows.where("prune")
    rules: list[Rule] = []
    while len(rules) < RULES:
        rule: Rule = ()
        while len(rule) < CONDITIONS:
            condition, good = _best(grow, rule, cuts)
            if condition is None:
                break
            rule += (condition,)
            if not good:
                break
        if not rule:
            break
        tried = [(rule[:k], *_counts(prune, _all(rule[:k]))) for k in range(len(rule), 0, -1)]
        rule, bad, good = max(tried, key=lambda t: ((t[1] + 1) / (t[1] + t[2] + 2), len(t[0])))
        if bad + good < SUPPORT or bad < PRECISION * (bad + good):
            break
        rules.append(rule)
        grow, prune = (part.where(~_all(rule)) for part in (grow, prune))
    return rules


def rule_number(rules: Sequence[Rule]) -> Column:
    """The number (from 1) of the first rule that fits, else null: the decision list."""
    out = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        out = F.when(_all(rules[i - 1]), F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The statistics of every document, base_failed (under 50 words, or more than half of
    them in repeated three-word windows), kept, and the number of the rejecting rule."""
    stats = statistics(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    own = [F.col(c) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    share = stats.select(*own, failed.alias("base_failed"), F.struct(*[c.alias(f) for f, c in features().items()]).alias("x"))
    number = rule_number([tuple(Condition(f"x.{c.feature}", c.above, c.threshold) for c in rule) for rule in rules])
    row = F.struct(*own, "base_failed", (~F.col("base_failed") & number.isNull()).alias("kept"), number.alias("rule"))
    # a generator of one row: no filter on the result is pushed into the statistics and computes them again
    return share.select(F.inline_outer(F.array(row)))
