"""Highlighting as Column expressions (HLT-1..7).  Sequential highlighting is
order-dependent, so it is an ``aggregate`` fold over an ordered array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curasift.functions import text as tx
from curasift.functions.classify import tag_is_valid, type_border, type_fill

# ---------------------------------------------------------------------------
# Markup produced around highlighted text.
# ---------------------------------------------------------------------------
KEYWORD_COLOR = "#FFFF00"
KEYWORD_SPAN = ('<span style="background-color: ', '">', '</span>')          # + color, + text
WEB_SPAN = ("<span class='tag_span ", "'>", "</span>")                        # + class, + text
TAG_STYLE = ('"background-color: rgb(', '); padding: 0px 0.35em; margin: 0px 0.25em; '
             'line-height: 1; border-radius: 0.25em; border: 1px solid; border-color: rgb(', ');"')
TAG_SPAN = ("<span style=", ">", "</span>")                                   # + style, + text
ALREADY_TAGGED = [str(i) for i in range(1, 13)]   # match texts '1'..'12' are never highlighted
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyword_span(kw, color: str = KEYWORD_COLOR) -> Column:
    return F.concat(F.lit(KEYWORD_SPAN[0] + color + KEYWORD_SPAN[1]), _col(kw), F.lit(KEYWORD_SPAN[2]))


def web_span(kw, cls) -> Column:
    return F.concat(F.lit(WEB_SPAN[0]), _col(cls), F.lit(WEB_SPAN[1]), _col(kw), F.lit(WEB_SPAN[2]))


def tag_span(kw, fill, border) -> Column:
    style = F.concat(F.lit(TAG_STYLE[0]), _col(fill), F.lit(TAG_STYLE[1]), _col(border), F.lit(TAG_STYLE[2]))
    return F.concat(F.lit(TAG_SPAN[0]), style, F.lit(TAG_SPAN[1]), _col(kw), F.lit(TAG_SPAN[2]))


def _unguarded(text: Column, needle: Column) -> Column:
    """needle occurs and its first occurrence is not right after '>' (a hit
    at position 1 is unguarded, quirk Q-20)."""
    return tx.let(F.instr(text, needle), lambda p: (F.length(needle) > 0) & (p > 0)
                  & ((p == 1) | (F.substring(text, p - 1, 1) != ">")))


def py_title(c) -> Column:
    """Python ``str.title`` for ASCII text: upper a letter after a non-letter,
    lower the others."""
    chars = F.split(_col(c), "", -1)
    chars = F.filter(chars, lambda x: x != "")
    out = F.transform(chars, lambda ch, i: F.when(
        (i == 0) | ~F.get(chars, i - 1).rlike("^[A-Za-z]$"), F.upper(ch)).otherwise(F.lower(ch)))
    return F.array_join(out, "")


def highlight_keyword(text, kw, mode: str = "yes", color: str = KEYWORD_COLOR,
                      subscriptions: bool = False) -> Column:
    """HLT-1 (and its masked input for HLT-2).  Both sides are masked first.
    mode 'yes': when the keyword occurs case-insensitively (first hit not after
    '>'), the whole text is lower-cased and every occurrence wrapped; failing
    that, the title-cased keyword is tried case-sensitively.  mode 'no':
    case-sensitive replace."""
    colon = not subscriptions
    both = F.struct(tx.mask_special(text, colon_rule=colon).alias("t"), tx.mask_special(kw, colon_rule=colon).alias("k"))

    def body(b):
        t, k = b["t"], b["k"]
        if mode == "no":
            return F.when(F.length(k) > 0, F.replace(t, k, keyword_span(k, color))).otherwise(t)
        lt, lk = F.lower(t), F.lower(k)
        kt = py_title(k)
        return (F.when(_unguarded(lt, lk), F.replace(lt, lk, keyword_span(lk, color)))
                .when(_unguarded(t, kt), F.replace(t, kt, keyword_span(kt, color)))
                .otherwise(t))
    return tx.let(both, body)


def highlight_keyword_subscriptions(text, kw, color: str = KEYWORD_COLOR) -> Column:
    """HLT-2: HLT-1 on MSK-2 text, then section marks and wanted sections only."""
    return tx.keep_sections(tx.mark_sections(highlight_keyword(text, kw, "yes", color, True)))


def _guarded_replace(text: Column, kw: Column, span, all_cases: bool) -> Column:
    """Every occurrence of the keyword wrapped, unless the first follows '>';
    with ``all_cases`` then its lower, upper and title case in turn, each on the
    text as it then is (a variant equal to an earlier one finds it wrapped)."""
    out = text
    for form in (lambda k: k, F.lower, F.upper, py_title)[:4 if all_cases else 1]:
        k = form(kw)
        out = tx.let(out, _wrap(k, span))
    return out


def _wrap(k: Column, span):
    return lambda t: F.when(_unguarded(t, k), F.replace(t, k, span(k))).otherwise(t)


def highlight_keyword_for_web(text, kw, cls, all_cases: bool = False) -> Column:
    """HLT-4: class span; ``all_cases`` is the mode that tries each case."""
    return _guarded_replace(_col(text), _col(kw), lambda k: web_span(k, cls), all_cases)


def highlight_keyword_tag(text, kw, fill, border, all_cases: bool = False) -> Column:
    """HLT-3: inline-styled span; ``all_cases`` as in HLT-4."""
    return _guarded_replace(_col(text), _col(kw), lambda k: tag_span(k, fill, border), all_cases)


def highlight_keyword_list(text, kws) -> Column:
    """HLT-5: all keywords of an array in one pass (longest first), on the
    masked, lower-cased text (quirk Q-9 fixed: earlier spans are not
    re-masked)."""
    t = F.lower(tx.mask_special(text))
    ks = F.filter(F.transform(_col(kws), lambda k: F.lower(tx.mask_special(k))), lambda k: F.length(k) > 0)
    ks = F.array_sort(F.array_distinct(ks), lambda a, b: F.when(F.length(a) > F.length(b), -1)
                      .when(F.length(a) < F.length(b), 1)
                      .when(a < b, -1).when(a > b, 1).otherwise(0))
    pat = F.concat(F.lit("("), F.array_join(F.transform(ks, tx.regex_quote), "|"), F.lit(")"))
    rep = F.lit(KEYWORD_SPAN[0] + KEYWORD_COLOR + KEYWORD_SPAN[1] + "$1" + KEYWORD_SPAN[2])
    return F.when(F.size(ks) > 0, F.regexp_replace(t, pat, rep)).otherwise(t)


def highlight_tags(text, tags, for_web: bool = True) -> Column:
    """HLT-6: fold over tags (array<struct<match_text, type>> in text order):
    each distinct *valid* match text once, with the type of its first tag."""
    def step(acc, x):
        done = F.array_contains(acc["done"], x["match_text"])
        valid = tag_is_valid(x["match_text"], x["type"])
        if for_web:
            new = highlight_keyword_for_web(acc["text"], x["match_text"], x["type"])
        else:
            new = highlight_keyword_tag(acc["text"], x["match_text"], type_fill(x["type"]),
                                        type_border(x["type"]))
        go = ~done & valid
        return F.struct(F.when(go, new).otherwise(acc["text"]).alias("text"),
                        F.when(go, F.concat(acc["done"], F.array(x["match_text"])))
                        .otherwise(acc["done"]).alias("done"))
    init = F.struct(_col(text).alias("text"),
                    F.array(*[F.lit(s) for s in ALREADY_TAGGED]).alias("done"))
    return F.aggregate(F.coalesce(_col(tags), F.array().cast("array<struct<match_text:string,type:string>>")),
                       init, step, lambda acc: acc["text"])


def highlight_tags_from_list(text, tags) -> Column:
    """HLT-7: same fold over parsed tag lists (array<struct<match_text, type>>
    in entity order), without the validity test."""
    def step(acc, x):
        done = F.array_contains(acc["done"], x["match_text"])
        new = highlight_keyword_for_web(acc["text"], x["match_text"], x["type"])
        return F.struct(F.when(~done, new).otherwise(acc["text"]).alias("text"),
                        F.when(done, acc["done"]).otherwise(F.concat(acc["done"], F.array(x["match_text"]))).alias("done"))
    init = F.struct(_col(text).alias("text"),
                    F.array(*[F.lit(s) for s in ALREADY_TAGGED]).alias("done"))
    return F.aggregate(F.coalesce(_col(tags), F.array().cast("array<struct<match_text:string,type:string>>")),
                       init, step, lambda acc: acc["text"])
