"""Main text of web pages by the distribution of text over lines.

1. *Markup.*  Tags, comments, scripts and styles are stripped.  The beginning and the end of
   a block element end a line, so a paragraph is a line, and elements that close and open
   one after the other leave blank lines between, as a page's source has.  Lines in menus,
   headers, footers, sidebars, notices, adverts, forms and comments (known by element, role,
   class or id) stay as lines without weight; the header of an article itself is no page header.
2. *Distribution.*  A line weighs the length of its text without links, and nothing if links are
   more than half of it; if the page marks its article (``article``, ``main``, or the role), lines outside it
   weigh nothing.  The block of a line is the sum of weights of ``WINDOW`` lines from it on.
3. *Surge and dive.*  A region of text begins where the block rises from nothing (the surge) and
   ends where the block falls to nothing (the dive).  In a page that marks its article all regions are kept; in
   others those whose highest block reaches ``LEAST`` characters or ``SHARE`` of the highest of the page.
   All lines of a region that aren't boilerplate are kept, whatever their length.

Character references are decoded as browsers do, white space in a line becomes one space, and
lines are joined by a line feed.

Defined results: a null or empty page, and one without text, has an empty text; a page's result
depends on its html alone, so repeated rows have equal results; an empty table gives an empty
result.  A page is handled whole in one task.  Other columns don't matter to ``page_texts``,
which returns its own."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curasift.llm.common import column, slices

#: Lines in a block; least height of a region's highest block, and its least share of the highest.
WINDOW, LEAST, SHARE = 3, 86, 0.3

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td
tfoot th thead tr ul""".split())
#: Elements, roles and words of class or id that mark what isn't the article.
BOILERPLATE = frozenset("""aside audio button canvas datalist dialog fieldset footer form head iframe map math menu nav noembed noframes noscript object
script search select style svg template textarea title video xmp""".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
MARKS = frozenset("""ad ads adsense advert adverts advertisement advertisements advertising alert aside banner breadcrumb breadcrumbs comment comments
commentlist consent cookie cookies copyright disclaimer disqus footer form gdpr header hidden legal login masthead menu menubar modal nav navbar navigation
newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share
sharebar sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription toast toolbar widget""".split())
ARTICLE_ROLES = frozenset(("main", "article"))
#: Opening a key closes an open element of the value, up to the given bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
_P_BOUNDS = frozenset(("article", "aside", "body", "button", "div", "footer", "form", "header", "main", "nav", "section", "td", "th"))


@dataclass
class Line:
    text: str
    linked: int       # characters inside links
    boilerplate: bool
    article: bool     # inside an element that marks the article


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _marks(name: str, given: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """Is the element boilerplate; does it mark the article?"""
    role = given.get("role", "").lower()
    marks_article = name in ARTICLE_ROLES or role in ARTICLE_ROLES or given.get("itemprop", "").lower() == "articlebody"
    own_header = in_article and name == "header"
    if name in BOILERPLATE or role in ROLES or name == "header" and not in_article or "hidden" in given or given.get("aria-hidden", "").lower() == "true":
        return True, marks_article
    if "display:none" in given.get("style", "").replace(" ", "").lower():
        return True, marks_article
    if name in ("html", "body") or own_header:
        return False, marks_article
    for word in f"{given.get('class', '')} {given.get('id', '')}".lower().split():
        parts = _NAME.findall(word)
        # "has-sidebar" tells what there is besides; an article's own header is no page header
        if parts and parts[0] not in ("has", "is", "no", "not", "with", "without"):
            found = MARKS.intersection(parts)
            if found - {"header"} or found and not in_article and not re.fullmatch("h[1-6]", name):
                return True, marks_article
    return False, marks_article


def lines_of(page: str) -> list[Line]:
    """The lines of a page; blank ones are where block elements follow one another."""
    out: list[Line] = []
    held: list[str] = []
    links: list[str] = []
    # open elements: name, boilerplate here or above, article here or above
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    open_links = 0

    def text(part: str) -> None:
        if part:
            held.append(part)
            if open_links:
                links.append(part)

    def end_line() -> None:
        _, boilerplate, article = stack[-1]
        found = " ".join(unescape("".join(held)).split()) if held else ""
        out.append(Line(found, len(" ".join(unescape(" ".join(links)).split())) if links else 0, boilerplate, article))
        held.clear()
        links.clear()

    def close(at: int) -> None:
        nonlocal open_links
        while len(stack) > at:
            if stack[-1][0] in BLOCKS or stack[-1][1] != stack[-2][1]:
                end_line()
            open_links -= stack.pop()[0] == "a"

    at = 0
    while match := _TAG.search(page, at):
        text(page[at:match.start()])
        at = match.end()
        if match[1] is None:
            continue
        name = match[1].lower()
        if page[match.start() + 1] == "/":
            where = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if where:
                close(where)
            elif name in BLOCKS:
                end_line()
            continue
        if name == "br":
            text(" ")
            continue
        if name in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in _P_BOUNDS:
                    break
            closed, bounds = CLOSES.get(name, (frozenset(), frozenset()))
            for i in range(len(stack) - 1, 0, -1) if closed else ():
                if stack[i][0] in closed:
                    close(i)
                    break
                if stack[i][0] in bounds:
                    break
        if name == "a" and open_links:  # a link in a link closes the first
            close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "a"))
        _, above, inside = stack[-1]
        boilerplate, article = _marks(name, _attributes(match[2]), inside)
        if name in BLOCKS or boilerplate and not above:
            end_line()
        if name in RAW:
            closing = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = closing.start() if closing else len(page)
            after = page.find(">", at)
            at = len(page) if after < 0 else after + 1
        elif name not in VOID:
            stack.append((name, above or boilerplate, inside or article and not (above or boilerplate)))
            open_links += name == "a"
    text(page[at:])
    close(1)
    end_line()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, block by block."""
    lines = lines_of(page or "")
    marked = any(x.article and not x.boilerplate and x.text for x in lines)
    weight = np.asarray([0 if x.boilerplate or marked and not x.article or not marked and 2 * x.linked > len(x.text) else len(x.text) if marked else len(x.text) - x.linked for x in lines], np.int64)
    total = np.cumsum(np.r_[0, weight])
    block = total[np.minimum(np.arange(len(weight)) + WINDOW, len(weight))] - total[:-1]
    if not len(block) or not block.max():
        return ""
    text = block > 0
    surges, dives = np.flatnonzero(text & ~np.r_[False, text[:-1]]), np.flatnonzero(text & ~np.r_[text[1:], False]) + 1
    least = 1 if marked else min(LEAST, SHARE * int(block.max()))
    kept = [x.text for a, b in zip(surges.tolist(), dives.tolist(), strict=True) if block[a:b].max() >= least
            for x in lines[a:b] if x.text and not x.boilerplate and (x.article or not marked)]
    return "\n".join(kept)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x.as_py()) for x in column(batch, "html")]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
