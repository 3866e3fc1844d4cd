"""Text cleaning, masking, sentence splitting and section marking as Column
expressions (JVM-side, inside whole-stage codegen; no Python UDF).

"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# Characters replaced by a space when masking index syntax (MSK-1); the colon
# has its own rule (see mask_special).
MASK_CHARS = '\\+-&|!(){}[]^"~*?/'
# Sentence splitter vocabulary (TXT-3).
SPLIT_PREFIXES = "(Mr|St|Mrs|Ms|Dr)[.]"
SPLIT_SUFFIXES = "(Inc|Ltd|Jr|Sr|Co)"
SPLIT_STARTERS = ("(Mr|Mrs|Ms|Dr|He\\s|She\\s|It\\s|They\\s|Their\\s|Our\\s|We\\s|But\\s"
                  "|However\\s|That\\s|This\\s|Wherever)")
# "\s" is written as this explicit class so Java and RE2 agree exactly.
SPACE_CLASS = "[\\t\\n\\f\\r ]"
SPLIT_ACRONYMS = "([A-Z][.][A-Z][.](?:[A-Z][.])?)"
SPLIT_WEBSITES = "[.](com|net|org|io|gov)"
SPLIT_ALPHA = "([A-Za-z])"
# Section headers of subscription e-mails (SEC-1), with the two fused
# literals of the original separated (quirk Q-8, fixed).
SECTION_HEADERS = ['link:', 'text:', 'content:', 'type:', 'compnay:', 'date:', 'headline:',
                   'source:', 'Link:', 'Text:', 'Content:', 'Type:', 'Date:', 'Headline:',
                   'Source:', 'Company:']
# Sections kept by the subscription highlighter (FLT-9), Q-8 fixed likewise.
WANTED_SECTIONS = ['text:', 'content:', 'type:', 'date:', 'headline:', 'source:', 'Company:',
                   'company:', 'Text:', 'Content:', 'Type:', 'Date:', 'Headline:', 'Source:']
# ---------------------------------------------------------------------------

# The alternatives alone, for lookaround.
_SPLIT_PREFIX = SPLIT_PREFIXES.removesuffix("[.]").strip("()")
_SPLIT_SITE = SPLIT_WEBSITES.removeprefix("[.]").strip("()")
_SPLIT_SUFFIX = SPLIT_SUFFIXES.strip("()")

WORD_CHARS = "A-Za-z0-9_"
# Whitespace as stripped at both ends (ASCII whitespace incl. vertical tab).
_WS = "[ \\t\\n\\r\\f\\x0B]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _java_class(chars: str) -> str:
    """A Java regex character class matching exactly ``chars``."""
    out = []
    for ch in chars:
        out.append("\\" + ch if ch in "\\[]^-&" else ch)
    return "[" + "".join(out) + "]"


def clean_line_breaks(c) -> Column:
    """TXT-1: CRLF/LF/TAB -> space, collapse spaces once, curly apostrophe ->
    ', then drop non-ASCII, in that order."""
    s = _col(c)
    s = F.replace(s, F.lit("\r\n"), F.lit(" "))
    return _clean_within_lines(F.replace(s, F.lit("\n"), F.lit(" ")))


def _clean_within_lines(s: Column) -> Column:
    """TXT-1 but for line breaks, which stay."""
    s = F.replace(s, F.lit("\t"), F.lit(" "))
    s = F.regexp_replace(s, "  +", " ")
    s = F.replace(s, F.lit("\u2019"), F.lit("'"))
    return F.regexp_replace(s, "[^\\x00-\\x7F]", "")


def let(expr: Column, body) -> Column:
    """Bind ``expr`` once and use it several times in ``body`` (a one-element
    ``transform``): Spark does not share a sub-expression between the
    branches of a ``when`` or across lambda bodies, so a large one
    referenced twice would be evaluated twice."""
    return F.element_at(F.transform(F.array(expr), body), 1)


_WS_CHARS = " \t\n\r\f\x0b"


def strip_ws(c) -> Column:
    """Strip ASCII whitespace (incl. vertical tab) at both ends."""
    return F.btrim(_col(c), F.lit(_WS_CHARS))


def mask_special(c, colon_rule: bool = True) -> Column:
    """MSK-1 (colon_rule=True) / MSK-2 (False): replace index-syntax characters
    by a space; colons go too only when the character after the *first* colon
    is a digit or a space; then strip and collapse spaces."""
    s = F.regexp_replace(_col(c), _java_class(MASK_CHARS.replace("/", "")), " ")
    if colon_rule:
        def colon(m):
            pos = F.instr(m, ":")
            nxt = F.substring(m, pos + 1, 1)
            return F.when((pos > 0) & (pos < F.length(m)) & nxt.rlike("^[0-9 ]$"),
                          F.replace(m, F.lit(":"), F.lit(" "))).otherwise(m)
        s = let(s, colon)
    s = F.replace(s, F.lit("/"), F.lit(" "))
    return F.regexp_replace(strip_ws(s), "  +", " ")


def _sentence_parts(c) -> Column:
    """The stripped pieces of a text between sentence ends, the last one being the
    unterminated tail (maybe blank).

    Each rule is a pass over the text as the rules before it left it.  Nearly all of them change a
    full stop for what stands around it, so their patterns begin with the full stop and look
    back: a text is scanned for one character, not tried at every letter."""
    t = F.concat(F.lit(" "), _col(c), F.lit("  "))
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    # prefixes, websites and 'Ph.D.' (but for one that is part of a website)
    t = F.regexp_replace(t, f"[.](?:(?<=(?:{_SPLIT_PREFIX}|Ph[.]D)[.])|(?={_SPLIT_SITE})|(?<=Ph[.])(?=D[.](?!{_SPLIT_SITE})))", "<prd>")
    starters = SPLIT_STARTERS.replace("\\s", SPACE_CLASS)
    t = F.regexp_replace(t, SPACE_CLASS + SPLIT_ALPHA + "[.] ", " $1<prd> ")

    def acronyms(t):
        t = F.regexp_replace(t, f"[.] (?<=[A-Z][.][A-Z][.] )(?={starters})", ".<stop> ")
        t = F.regexp_replace(t, f"[.]{SPLIT_ALPHA}[.]{SPLIT_ALPHA}[.](?<=[A-Za-z][.].[.].[.])", "<prd>$1<prd>$2<prd>")
        return F.regexp_replace(t, f"[.]{SPLIT_ALPHA}[.](?<=[A-Za-z][.].[.])", "<prd>$1<prd>")
    t = let(t, lambda t: F.when(t.rlike("[.][A-Za-z][.]"), acronyms(t)).otherwise(t))
    t = F.regexp_replace(t, " " + SPLIT_SUFFIXES + "[.] " + starters, " $1<stop> $2")
    # suffixes and single letters
    t = F.regexp_replace(t, f"[.](?<= (?:{_SPLIT_SUFFIX}|[A-Za-z])[.])", "<prd>")

    def quotes(t):
        t = F.replace(t, F.lit(".\u201d"), F.lit("\u201d."))
        t = F.replace(t, F.lit('."'), F.lit('".'))
        t = F.replace(t, F.lit('!"'), F.lit('"!'))
        return F.replace(t, F.lit('?"'), F.lit('"?'))
    t = let(t, lambda t: F.when(F.contains(t, F.lit('"')) | F.contains(t, F.lit("\u201d")), quotes(t)).otherwise(t))
    t = F.regexp_replace(t, "([.?!])", "$1<stop>")
    t = F.replace(t, F.lit("<prd>"), F.lit("."))
    return F.transform(F.split(t, "<stop>", -1), strip_ws)


def split_sentences(c, keep_tail: bool = True) -> Column:
    """TXT-3: abbreviation-protecting regex sentence splitter -> array<string>.

    keep_tail=False is the literal behaviour (an unterminated tail is dropped);
    keep_tail=True keeps a non-blank tail (quirk Q-1)."""
    parts = _sentence_parts(c)
    if keep_tail:
        # every piece but the last ends with a terminator, so only the last
        # (the unterminated tail) can be blank
        return F.array_remove(parts, "")
    return let(parts, lambda ps: F.slice(ps, 1, F.size(ps) - 1))


def _clean_sentences(sentences: Column) -> Column:
    """TXT-1 on all sentences at once: they hold no line feeds, so they are the
    lines of one text."""
    return _clean_within_lines(F.array_join(sentences, "\n"))


def text_to_sentences(c) -> Column:
    """TXT-2: split (tail kept, Q-1) then TXT-1 on every sentence."""
    return let(split_sentences(c, keep_tail=True), lambda ps: F.when(F.size(ps) == 0, ps)
               .otherwise(F.split(_clean_sentences(ps), "\n", -1)))


def document_text(c) -> Column:
    """TXT-4: cleaned sentences re-joined with one space."""
    return F.replace(_clean_sentences(split_sentences(c, keep_tail=True)), F.lit("\n"), F.lit(" "))


def mark_sections(c, headers=None) -> Column:
    """SEC-1: put ' || ' before every section header (single pass)."""
    hs = headers or SECTION_HEADERS
    alt = "|".join(h.replace(":", "\\:") for h in hs)
    return F.regexp_replace(_col(c), f"({alt})", " || $1")


def keep_sections(c, wanted=None) -> Column:
    """FLT-9: split on ' || ' and keep the pieces containing a wanted header."""
    ws = wanted or WANTED_SECTIONS
    parts = F.split(_col(c), " \\|\\| ", -1)
    kept = F.filter(parts, lambda x: F.exists(F.array(*[F.lit(w) for w in ws]),
                                              lambda h: F.contains(x, h)))
    return F.array_join(kept, " ")


def regex_quote(c) -> Column:
    """Quote a column value for use as a literal inside a Java regex."""
    return F.concat(F.lit("\\Q"), F.replace(_col(c), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def count_whole_word(text, kw) -> Column:
    """AGG-1 core: non-overlapping, whole-word occurrences of kw in text
    (caller lower-cases both); 0 for an empty keyword."""
    pat = F.concat(F.lit(f"(?<![{WORD_CHARS}])"), regex_quote(kw), F.lit(f"(?![{WORD_CHARS}])"))
    return F.when(F.length(_col(kw)) > 0, F.regexp_count(_col(text), pat)).otherwise(F.lit(0))


def tokens(c) -> Column:
    """Index tokens: ASCII word runs, lower-cased (no stemming, no stop words)."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit(f"[{WORD_CHARS}]+"), 0), F.lower)


def raw_tokens(c) -> Column:
    """Index tokens with their original case (same boundaries as ``tokens``)."""
    return F.regexp_extract_all(_col(c), F.lit(f"[{WORD_CHARS}]+"), 0)


def phrase_norm(c) -> Column:
    """A phrase as its lower-cased tokens joined by one space."""
    return F.array_join(tokens(c), " ")


def sanitize_title(c) -> Column:
    """FMT-1: ASCII only; drop backslashes, quotes, mojibake residues, double
    backticks and '//' (the stray-'b' stripping of Q-10 is not reproduced)."""
    s = F.regexp_replace(_col(c), "[^\\x00-\\x7F]", "")
    s = F.replace(s, F.lit("\\"), F.lit(""))
    s = F.replace(s, F.lit("'"), F.lit(""))
    s = F.replace(s, F.lit("xe2x80x99"), F.lit(""))
    s = F.replace(s, F.lit("xc2xae"), F.lit(""))
    s = F.replace(s, F.lit("``"), F.lit(""))
    s = F.replace(s, F.lit("//"), F.lit(""))
    return F.regexp_replace(s, '^"+|"+$', "")


def display_type(c) -> Column:
    """FMT-2: '_' -> space, title case."""
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))
