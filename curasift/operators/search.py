"""Text search over documents: phrase, conjunctive, proximity
and sloppy-phrase search, and BM25-ranked top-k.

Plan shape: a phrase is local to its document, so occurrences are found without
grouping.  Each phrase is anchored at one of its tokens.  With a phrase table
within the broadcast bound, the token starts that are no anchor go inside the row,
before anything is exploded; the others travel with the few tokens around
them (never the text) into a hash join with the broadcast phrases, and the rest
of the phrase is compared in the join condition.  With a larger phrase table the
anchor is the phrase's rarest token, by one count of the corpus's tokens, and
tokens that are still frequent are dealt over several salts, the phrases with
such an anchor copied to each.  There is no document x phrase cross product and
no per-phrase rescan of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curasift.functions import text as tx
from curasift.operators.joins import MAX_BROADCAST_BYTES, broadcast_if_small, estimated_bytes
from curasift.session import cut_lineage

#: Most anchors compared inside the row (as one literal set).
MAX_ROW_ANCHORS = 5000
#: A token with more than one in so many of all tokens is dealt over salts; there are fewer such tokens than this.
HOT_SHARE = 1000


def phrase_table(phrases: DataFrame, col: str = "phrase") -> DataFrame:
    """Distinct normalized phrases with their token list."""
    p = (phrases.select(tx.phrase_norm(F.col(col)).alias("phrase")).where(F.col("phrase") != "")
         .distinct())
    return p.select("phrase", F.split("phrase", " ").alias("ptoks"))


def each_element(df: DataFrame, array: str, pos: str, element: str) -> DataFrame:
    """One row per element of ``array``, which holds no nulls.  For an inner generator the
    optimizer adds a filter on the array's size, which computes the array twice, so the outer
    one is used and its rows for empty arrays go."""
    return df.select("*", F.posexplode_outer(array).alias(pos, element)).where(F.col(element).isNotNull())


def doc_tokens(docs: DataFrame, key="doc_key", text: str = "content",
               raw: bool = False) -> DataFrame:
    """(key..., pos, w[, rw]) for every token; only the key (and the token)
    is carried through the generator, never the text."""
    keys = [key] if isinstance(key, str) else list(key)
    t = each_element(docs.select(*keys, tx.raw_tokens(F.col(text)).alias("_t")), "_t", "pos", "rw").drop("_t")
    t = t.withColumn("w", F.lower("rw"))
    return t if raw else t.drop("rw")


def token_frequencies(docs: DataFrame, text: str = "content") -> DataFrame:
    """(w, n): how often each token occurs in the corpus, counted map-side first."""
    return each_element(docs.select(tx.tokens(F.col(text)).alias("_t")), "_t", "_pos", "w").groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def anchored(ptab: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """(phrase, n, w, off): each phrase's anchor token and its place.  The anchor
    is the rarest token by ``frequencies`` (w, n), else the longest one; the
    first of equals."""
    size = F.size("ptoks").alias("n")
    if frequencies is None:
        best = F.array_min(F.transform("ptoks", lambda t, i: F.struct((-F.length(t)).alias("k"), i.alias("off"), t.alias("w"))))
        return ptab.select("phrase", size, best["w"].alias("w"), best["off"].alias("off"))
    each = ptab.select("phrase", size, F.posexplode("ptoks").alias("off", "w")).join(frequencies.select("w", F.col("n").alias("k")), "w", "left")
    best = each.groupBy("phrase", "n").agg(F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "off", "w")).alias("b"))
    return best.select("phrase", "n", "b.w", "b.off")


def token_starts(docs: DataFrame, keys: list[str], text: str, back, longest, anchors: list[str] | None = None) -> DataFrame:
    """(key..., at, w, _g, _b): every token start, or those of ``anchors`` only, with the
    tokens from ``back`` before it (fewer at the beginning: ``_b``) to ``longest`` from it on.
    Starts that are no anchor end in the loop over the row's tokens; nothing is copied for them."""
    back, longest = (F.lit(x) if isinstance(x, int) else x for x in (back, longest))
    toks = each_element(docs.select(*keys, tx.raw_tokens(F.col(text)).alias("_t"), back.alias("_back"), longest.alias("_longest")), "_t", "at", "rw")
    toks = toks.withColumn("w", F.lower("rw"))
    if anchors is not None:
        toks = toks.where(F.col("w").isin(anchors))
    before = F.least("at", "_back")
    return toks.select(*keys, "at", "w", before.alias("_b"), F.slice("_t", F.col("at") - before + 1, before + F.col("_longest")).alias("_g"))


def salted(tokens: DataFrame, phrases: DataFrame, frequencies: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of the anchor join with a ``salt``: a token's rows are dealt over as many
    salts as it has parts of ``1 / HOT_SHARE`` of all tokens, its phrases are copied to each."""
    part = frequencies.agg((F.sum("n") / HOT_SHARE).alias("part")).scalar()
    # fewer than HOT_SHARE tokens can be hot, whatever the corpus
    hot = F.broadcast(frequencies.withColumn("part", part).where(F.col("n") > F.col("part")).select("w", F.ceil(F.col("n") / F.col("part")).cast("int").alias("salts")))
    dealt = tokens.join(hot, "w", "left").withColumn("salt", F.pmod(F.xxhash64(*by), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")).drop("salts")
    copied = phrases.join(hot, "w", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt, copied


def phrase_occurrences(docs: DataFrame, phrases: DataFrame, key="doc_key",
                       text: str = "content", with_text: bool = False, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(key..., phrase, n, start[, match_text]) for every occurrence of every
    phrase; ``match_text`` is the original-case span (tokens joined by one
    space).  A phrase table estimated within ``max_bytes`` is read when the plan is made
    (its anchors, and how far they reach) and broadcast; a larger one is joined by its rarest
    tokens."""
    keys = [key] if isinstance(key, str) else list(key)
    ptab = phrase_table(phrases)
    if estimated_bytes(ptab) <= max_bytes:
        p = anchored(ptab)
        reach = p.agg(F.max("off").alias("back"), F.max(F.col("n") - F.col("off")).alias("longest"), F.collect_set("w").alias("w")).first()
        anchors = sorted(reach.w) if len(reach.w) <= MAX_ROW_ANCHORS else None
        at, on, p = token_starts(docs, keys, text, reach.back or 0, reach.longest or 1, anchors), ["w"], F.broadcast(p)
    else:
        frequencies = cut_lineage(token_frequencies(docs, text))
        p = cut_lineage(anchored(ptab, frequencies))
        reach = p.agg(F.coalesce(F.max("off"), F.lit(0)).alias("back"), F.coalesce(F.max(F.col("n") - F.col("off")), F.lit(1)).alias("longest"))
        at = token_starts(docs, keys, text, reach.select("back").scalar(), reach.select("longest").scalar())
        (at, p), on = salted(at, p, frequencies, [*keys, "at"]), ["w", "salt"]
    span = F.array_join(F.slice("_g", F.col("_b") - F.col("off") + 1, F.col("n")), " ")
    occ = at.join(p, on).where((F.col("_b") >= F.col("off")) & (F.lower(span) == F.col("phrase")))
    start = (F.col("at") - F.col("off")).alias("start")
    return occ.select(*keys, "phrase", "n", start, *([span.alias("match_text")] if with_text else []))


def _closest(events: Column) -> Column:
    """The smallest distance between places of two slots, which may share a position: that of
    two neighbours in the sorted places."""
    def gap(places):
        before = lambda i: F.get(places, i - 1)
        return F.array_min(F.transform(places, lambda e, i: F.when((i > 0) & (before(i)["slot"] != e["slot"]), e["d"] - before(i)["d"])))
    return tx.let(events, gap)


def least_span(events: Column, later: Column, within: Column | None = None) -> Column:
    """The smallest ``max - min`` over all choices of one place per slot, no two slots at one
    position: a merge of the slots' sorted lists.  With ``within``, a span above it may be
    given as NULL.

    ``events``: array<struct<d, slot>>, ``d`` a place of a slot less the slot's offset, in any
    order; ``later``: for each slot the next slot of the same token, or -1.  The
    sorted events are folded once, keeping the last places of each slot (as many as slots
    share a token).  At each event, taken as the largest place, each slot takes its largest
    place so far, from the last slot to the first, those of one token in strictly falling positions; no
    other choice has a larger least place.  NULL if a slot has no place.  Two slots that
    share no token are the two nearest neighbours."""
    held = F.size(F.filter(later, lambda x: x >= 0)) + 1

    def step(state, e):
        seen = F.transform(state["seen"], lambda places, slot: F.when(
            slot == e["slot"], F.slice(F.concat(F.array(e["d"]), places), F.lit(1), held)).otherwise(places))

        def span(seen):
            def take(chosen, i):  # chosen: the places of slots i + 1, i + 2, ...
                following = F.get(later, i)
                below = F.when(following < 0, F.lit(2**31 - 1)).otherwise(F.get(chosen, following - i - 1) + (following - i))
                return F.concat(F.array(F.get(F.filter(F.get(seen, i), lambda d: d < below), F.lit(0))), chosen)
            chosen = F.aggregate(F.sequence(F.size(later) - 1, F.lit(0), F.lit(-1)), F.array().cast("array<int>"), take)
            return tx.let(chosen, lambda c: F.when(F.forall(c, lambda d: d.isNotNull()), e["d"] - F.array_min(c)))
        def last(s):  # no slot's place can be after its last one
            return F.forall(s, lambda places: F.coalesce(F.get(places, F.lit(0)) >= e["d"] - within, F.lit(False)))
        closer = span if within is None else lambda s: F.when(last(s), span(s))
        return tx.let(seen, lambda s: F.struct(s.alias("seen"), F.least(state["best"], closer(s)).alias("best")))

    start = F.struct(F.transform(later, lambda _: F.array().cast("array<int>")).alias("seen"), F.lit(None).cast("int").alias("best"))
    ordered = F.sort_array(events)
    return F.when((F.size(later) == 2) & F.forall(later, lambda x: x < 0), _closest(ordered)).otherwise(
        F.aggregate(ordered, start, step, lambda state: state["best"]))


def search_hits(docs: DataFrame, params: DataFrame, search_keys: list[str],
                key: str = "doc_key", text: str = "content") -> DataFrame:
    """QRY-1/2/3/4 for every search parameter row at once.

    ``params`` needs: search key columns (kept), ``keyphrase1``,
    ``keyphrase2`` (nullable) and ``keyphrase_distance`` (nullable int).
    Returns (key, *search_keys) for every matching document.
      * phrase only:             phrase1 occurs (QRY-1)
      * phrase + distance N:     sloppy phrase (QRY-4): every token of the phrase, at
                                 different positions, that would make the phrase if moved by at
                                 most N in all (the largest shift less the smallest)
      * two phrases:             both occur (QRY-2)
      * two phrases + distance:  |start2 - start1 - len1| <= N for some pair (QRY-3)
    The two with a distance merge the places of their slots (``least_span``).
    """
    slots = _slots(params, search_keys)
    occ = phrase_occurrences(docs, slots.select("phrase"), key, text)
    # the starts of the phrases of one parameter in one document
    j = occ.join(broadcast_if_small(slots), "phrase")
    g = (j.groupBy(key, *search_keys)
         .agg(F.size(F.collect_set("slot")).alias("_found"), F.any_value(F.struct("keyphrase_distance", "later")).alias("_p"),
              F.collect_list(F.when(F.col("keyphrase_distance").isNotNull(),
                                    F.struct((F.col("start") + F.col("shift")).alias("d"), "slot"))).alias("_events")))
    later, dist = F.col("_p.later"), F.col("_p.keyphrase_distance")
    near = F.when(dist.isNull() | (F.size(later) == 1), F.lit(True)).otherwise(least_span(F.col("_events"), later, dist) <= dist)
    return g.where((F.col("_found") == F.size(later)) & near).select(key, *search_keys)


def _slots(params: DataFrame, search_keys: list[str]) -> DataFrame:
    """(search keys, keyphrase_distance, slot, phrase, shift, later): what each parameter looks for."""
    norm = lambda c: F.coalesce(tx.phrase_norm(F.col(c)), F.lit(""))
    p = params.select(*search_keys, "keyphrase_distance", norm("keyphrase1").alias("_p1"), norm("keyphrase2").alias("_p2"))
    slot = lambda phrase, shift: F.struct(phrase.alias("phrase"), shift.cast("int").alias("shift"))
    words = F.split("_p1", " ")
    both = F.array(slot(F.col("_p1"), F.size(words)), slot(F.col("_p2"), F.lit(0)))
    sloppy = F.transform(words, lambda w, i: slot(w, -i))
    listed = (F.when(F.col("_p1") == "", F.array().cast("array<struct<phrase:string,shift:int>>"))
              .when(F.col("_p2") != "", both).when(F.col("keyphrase_distance").isNotNull(), sloppy)
              .otherwise(F.array(slot(F.col("_p1"), F.lit(0)))))
    p = p.withColumn("_slots", listed)
    # two given phrases are merged as they are; only the tokens of one phrase have to differ in position
    same = F.transform("_slots", lambda s, i: F.coalesce(
        F.array_min(F.filter(F.sequence(F.lit(0), F.size("_slots") - 1), lambda k: (k > i) & (F.get("_slots", k)["phrase"] == s["phrase"]))), F.lit(-1)))
    later = F.when(F.col("_p2") != "", F.array(F.lit(-1), F.lit(-1))).otherwise(same)
    p = p.where(F.size("_slots") > 0).select(*search_keys, "keyphrase_distance", "_slots", later.alias("later"))
    return p.select(*search_keys, "keyphrase_distance", "later", F.posexplode("_slots").alias("slot", "_s")).select(
        *search_keys, "keyphrase_distance", "later", "slot", "_s.phrase", "_s.shift")


def bm25_ranked(tf: DataFrame, stats: DataFrame, q: DataFrame, k: int, key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, key, score, rank <= ``k`` from the term counts ``tf`` (w, key, dl, tf) of the
    queries' terms ``q`` (query_id, w) and the one-row ``stats`` (N, avgdl).

    The per-query cut is a window-group limit (rank <= k): Spark evaluates it
    with a partial top-k before the shuffle, so no query's group is collected
    whole."""
    df_ = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    one = F.lit(1).alias("_one")
    s = (tf.join(df_, "w").select("*", one)
         .join(F.broadcast(stats.select("*", one)), "_one")  # one-row corpus stats
         .withColumn("idf", F.log(F.lit(1.0) + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
         .withColumn("part", F.col("idf") * F.col("tf") * (k1 + 1)
                     / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))))
    # scores are rounded to 6 decimals before ranking so that equal scores
    # tie-break on the key whatever the order of the floating-point sum
    scored = (s.join(broadcast_if_small(q), "w").groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_key",
               text: str = "content", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """QRY-6 / TOP-5: BM25 score of every matching document for every query
    (query terms = distinct tokens of ``query``), top ``k`` per ``query_id``
    by score desc, key asc.  Document frequencies and lengths come from the
    whole ``docs`` table.  For many searches over one corpus see ``postings``."""
    q = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("query")))).alias("w"))
    lists = docs.select(key, tx.tokens(F.col(text)).alias("_t")).withColumn("dl", F.size("_t"))
    stats = lists.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl"))
    tf = (each_element(lists, "_t", "_pos", "w").join(broadcast_if_small(q.select("w").distinct()), "w")
          .groupBy(key, "dl", "w").agg(F.count(F.lit(1)).alias("tf")))
    return bm25_ranked(tf, stats, q, k, key, k1, b)
