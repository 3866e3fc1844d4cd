"""DuckDB SQL fragments that mirror the Column expressions of
``curasift.functions`` (RE2 regexes, 1-based lists).  Used only to build the
oracle SQL texts that check each Spark query; nothing here runs on Spark."""

from __future__ import annotations

from curasift.functions import text as tx


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rr(expr: str, pat: str, rep: str) -> str:
    return f"regexp_replace({expr}, {q(pat)}, {q(rep)}, 'g')"


def rep(expr: str, a: str, b: str) -> str:
    return f"replace({expr}, {q(a)}, {q(b)})"


WS = "[ \\t\\n\\r\\f\\x0B]"


def strip_ws(e: str) -> str:
    return rr(e, f"^{WS}+|{WS}+$", "")


def clean_line_breaks(e: str) -> str:
    s = f"replace({e}, chr(13) || chr(10), ' ')"
    s = f"replace({s}, chr(10), ' ')"
    s = f"replace({s}, chr(9), ' ')"
    s = rr(s, " +", " ")
    s = f"replace({s}, chr(8217), '''')"
    return rr(s, "[^\\x00-\\x7F]", "")


def _class(chars: str) -> str:
    out = []
    for ch in chars:
        out.append("\\" + ch if ch in "\\[]^-&" else ch)
    return "[" + "".join(out) + "]"


def mask_special(e: str, colon_rule: bool = True) -> str:
    s = rr(e, _class(tx.MASK_CHARS.replace("/", "")), " ")
    if colon_rule:
        s = (f"(select case when p > 0 and p < length(m) and regexp_matches(substr(m, p + 1, 1), '^[0-9 ]$') "
             f"then replace(m, ':', ' ') else m end from (select m, strpos(m, ':') as p from (select {s} as m)))")
    s = f"replace({s}, '/', ' ')"
    return rr(strip_ws(s), " +", " ")


def split_sentences(e: str, keep_tail: bool = True) -> str:
    t = f"(' ' || {e} || '  ')"
    t = f"replace({t}, chr(10), ' ')"
    t = rr(t, tx.SPLIT_PREFIXES, "\\1<prd>")
    t = rr(t, tx.SPLIT_WEBSITES, "<prd>\\1")
    t = rep(t, "Ph.D.", "Ph<prd>D<prd>")
    starters = tx.SPLIT_STARTERS.replace("\\s", tx.SPACE_CLASS)
    t = rr(t, tx.SPACE_CLASS + tx.SPLIT_ALPHA + "[.] ", " \\1<prd> ")
    t = rr(t, tx.SPLIT_ACRONYMS + " " + starters, "\\1<stop> \\2")
    t = rr(t, tx.SPLIT_ALPHA + "[.]" + tx.SPLIT_ALPHA + "[.]" + tx.SPLIT_ALPHA + "[.]",
           "\\1<prd>\\2<prd>\\3<prd>")
    t = rr(t, tx.SPLIT_ALPHA + "[.]" + tx.SPLIT_ALPHA + "[.]", "\\1<prd>\\2<prd>")
    t = rr(t, " " + tx.SPLIT_SUFFIXES + "[.] " + starters, " \\1<stop> \\2")
    t = rr(t, " " + tx.SPLIT_SUFFIXES + "[.]", " \\1<prd>")
    t = rr(t, " " + tx.SPLIT_ALPHA + "[.]", " \\1<prd>")
    t = f"replace({t}, '.' || chr(8221), chr(8221) || '.')"
    t = rep(t, '."', '".')
    t = rep(t, '!"', '"!')
    t = rep(t, '?"', '"?')
    t = rep(t, ".", ".<stop>")
    t = rep(t, "?", "?<stop>")
    t = rep(t, "!", "!<stop>")
    t = rep(t, "<prd>", ".")
    parts = f"string_split({t}, '<stop>')"
    if keep_tail:
        body = (f"(select case when {strip_ws('ps[len(ps)]')} <> '' then ps else ps[1:len(ps)-1] end "
                f"from (select {parts} as ps))")
    else:
        body = f"(select ps[1:len(ps)-1] from (select {parts} as ps))"
    return f"list_transform({body}, lambda x: {strip_ws('x')})"


def text_to_sentences(e: str) -> str:
    return f"list_transform({split_sentences(e, True)}, lambda y: {clean_line_breaks('y')})"


def document_text(e: str) -> str:
    return f"array_to_string({text_to_sentences(e)}, ' ')"


def mark_sections(e: str) -> str:
    alt = "|".join(h for h in tx.SECTION_HEADERS)
    return rr(e, f"({alt})", " || \\1")


def keep_sections(e: str) -> str:
    arr = "[" + ", ".join(q(w) for w in tx.WANTED_SECTIONS) + "]"
    return (f"array_to_string(list_filter(string_split({e}, ' || '), "
            f"lambda z: len(list_filter({arr}, lambda h: contains(z, h))) > 0), ' ')")


WORD = "[^A-Za-z0-9_]"


def count_whole_word(text: str, kw: str) -> str:
    """Whole-word non-overlapping count without look-around: every separator
    is doubled in text and keyword, then separator-kw-separator is counted."""
    dt = f"regexp_replace(' ' || {text} || ' ', '({WORD})', '\\1\\1', 'g')"
    dk = f"regexp_replace({kw}, '({WORD})', '\\1\\1', 'g')"
    pat = f"'{WORD}' || regexp_escape({dk}) || '{WORD}'"
    return f"(case when length({kw}) > 0 then len(regexp_extract_all({dt}, {pat})) else 0 end)"


def tokens(e: str) -> str:
    return f"list_transform(regexp_extract_all({e}, '[A-Za-z0-9_]+'), lambda w: lower(w))"


def raw_tokens(e: str) -> str:
    return f"regexp_extract_all({e}, '[A-Za-z0-9_]+')"


def phrase_norm(e: str) -> str:
    return f"array_to_string({tokens(e)}, ' ')"


def sanitize_title(e: str) -> str:
    s = rr(e, "[^\\x00-\\x7F]", "")
    s = rep(s, "\\", "")
    s = rep(s, "'", "")
    s = rep(s, "xe2x80x99", "")
    s = rep(s, "xc2xae", "")
    s = rep(s, "``", "")
    s = rep(s, "//", "")
    return rr(s, '^"+|"+$', "")


def initcap(e: str) -> str:
    """Spark initcap: upper first letter of each space-separated word, lower the rest."""
    return (f"array_to_string(list_transform(string_split(lower({e}), ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")


def display_type(e: str) -> str:
    return initcap(f"replace({e}, '_', ' ')")


def values_cte(name: str, cols: list[str], rows: list[tuple]) -> str:
    """An inline VALUES CTE body from Python rows (NULL for None)."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return q(str(v))
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(cols)}) as (values {body})"
