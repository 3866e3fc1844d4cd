"""FUZ-1: indel similarity 0..100 (fuzzy ratio) as a Column expression, and the
character bounds that decide most pairs without it.

ratio(a, b) = round_half_even(200 * LCS(a, b) / (len a + len b)); 0 when
either string is empty.  The LCS is bit-parallel: the characters of ``a`` are the
bits of a few longs (``LIMB`` each), ``b`` is folded over them with one addition and a few
bit operations per character and long.  Everything stays in the JVM, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curasift.functions import text as tx

#: Characters in one long: sums of two such numbers don't overflow.
LIMB = 62
_ONES = (1 << LIMB) - 1
#: The commonest characters of names, rarest first; any other counts as rarer.
COMMON = "qjxzwkvfybghpmducltsnroaie #0"


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, "", -1), lambda x: x != "")


def _shifted(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def _masks(a: Column, b: Column, limb: Column) -> Column:
    """For each character of ``b``, where it stands among the characters of ``a`` in the limb."""
    part = F.slice(a, limb * LIMB + 1, LIMB)

    def table(p):
        kinds = F.array_distinct(p)
        bits = F.transform(kinds, lambda k: F.aggregate(
            F.transform(p, lambda c, i: F.when(c == k, _shifted(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y)))
        return F.map_from_arrays(kinds, bits)
    return tx.let(part, lambda p: tx.let(table(p), lambda t: F.transform(b, lambda c: F.coalesce(F.try_element_at(t, c), F.lit(0).cast("long")))))


def _one_limb(a: Column, b: Column) -> Column:
    ones = F.lit(_ONES).cast("long")
    fold = F.aggregate(_masks(a, b, F.lit(0)), ones, lambda v, m: ((v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m)))).bitwiseAND(ones))
    return F.lit(LIMB) - F.bit_count(fold)


def _many_limbs(a: Column, b: Column) -> Column:
    """As ``_one_limb`` with the carry of each long's sum going into the next."""
    ones, zero = F.lit(_ONES).cast("long"), F.lit(0).cast("long")
    limbs = F.sequence(F.lit(0), F.ceil(F.size(a) / LIMB).cast("int") - 1)

    masks = F.transform(limbs, lambda i: _masks(a, b, i))

    def fold(ms):
        def each(v, j):
            def add(state, i):
                def parts(x, m):
                    total = x + x.bitwiseAND(m) + state["carry"]
                    return tx.let(total, lambda t: F.struct(F.shiftrightunsigned(t, LIMB).alias("carry"), F.concat(
                        state["out"], F.array(t.bitwiseOR(x.bitwiseAND(F.bitwise_not(m))).bitwiseAND(ones))).alias("out")))
                return parts(F.get(v, i), F.get(F.get(ms, i), j))
            start = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("out"))
            return F.aggregate(limbs, start, add, lambda s: s["out"])
        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.transform(limbs, lambda _: ones), each)
    bits = tx.let(masks, fold)
    return F.aggregate(bits, F.lit(0), lambda n, x: n + LIMB - F.bit_count(x))


def lcs_length(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return tx.let(F.struct(_chars(a).alias("a"), _chars(b).alias("b")), lambda s: F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0))
                  .when(F.size(s["a"]) <= LIMB, _one_limb(s["a"], s["b"])).otherwise(_many_limbs(s["a"], s["b"])))


def ratio(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    la, lb = F.length(a), F.length(b)
    r = F.bround(F.lit(200.0) * lcs_length(a, b) / (la + lb), 0).cast("int")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")) \
            .when((la == 0) | (lb == 0), F.lit(0)).otherwise(r)


def character_tokens(c: Column) -> Column:
    """The characters of a string, each with the number of its occurrence, rarest first: two
    strings have as many characters in common as tokens."""
    numbered = tx.let(F.array_sort(_chars(c)), lambda s: F.transform(s, lambda x, i: F.struct(
        (F.call_function("locate", F.lower(x), F.lit(COMMON)) - 40 * (i + 1 - F.array_position(s, x))).alias("k"),
        F.concat(x, (i + 1 - F.array_position(s, x)).cast("string")).alias("t"))))
    return F.transform(F.array_sort(numbered), lambda x: x["t"])


def could_exceed(shared: Column, la: Column, lb: Column, leeway: Column) -> Column:
    """False only if no two strings of these lengths with so many common characters can have a
    ratio above ``leeway``: a ratio is above it only if 200 * LCS / (la + lb) >= leeway + 0.5,
    and the LCS is no longer than ``shared``."""
    return (leeway < 0) | (400 * shared >= (2 * leeway + 1) * (la + lb))


def prefix_tokens(tokens: Column, leeway: Column) -> Column:
    """The rarest tokens of a string, of which it shares at least one with any string that it
    can have a ratio above ``leeway`` with: that shares some t * len / (200 - t) characters at
    least (t = leeway + 0.5), so at most the rest of its tokens can be missing."""
    least = F.greatest(F.lit(1), F.ceil((2 * leeway + 1) * F.size(tokens) / F.greatest(399 - 2 * leeway, F.lit(1))).cast("int"))
    return F.when(leeway < 0, F.array(F.lit(""))).otherwise(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - least + 1, F.lit(0))))
