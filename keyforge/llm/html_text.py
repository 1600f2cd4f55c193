"""Main text of web pages by line-block distribution (operator 2).

Markup is stripped to one line per block element.  Lines from menus, headers,
footers, side bars, notices, adverts, forms, scripts and reader comments stay
as empty lines, so they pull the density of their surroundings down.  The text
lengths are summed over sliding windows of ``WINDOW`` lines.  The text starts
where the sum surges from nothing and ends where it dives back; a run between
the two is kept if its densest window reaches the surge height.  Where a page
names its article (``article``, ``main``, ``itemprop=articleBody``), other
lines weigh nothing and any height suffices, so short articles stay whole.
Otherwise the height is ``SURGE`` characters, or half the densest window on
pages that have less, and lines that are mostly links weigh nothing.

Nulls and pages without text give the empty string.  Unclosed tags, quotes and
comments follow the HTML rules (what an open comment, script or tag swallows
is lost); cut-off character references stay as they are.  The work is linear
in the page length.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyforge.llm.common import ship

ship(__name__)

WINDOW = 3
SURGE = 86

# Element names of the HTML standard, and common class words of page furniture.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style template noscript iframe noembed noframes xmp textarea title select svg math object canvas audio video button".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody "
    "thead tfoot tr ul head".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_GAPS = set("div section ul ol dl table aside nav header footer form main article".split())
_FURNITURE = set("nav menu aside footer form search dialog head".split())
_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_CLASS_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup sidebar widget widgets nav navbar "
    "navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead topbar comment comments reply replies "
    "respond disqus related recommended recommendations share sharing social toolbar".split())
_HEADER_WORDS = {"header", "heading-bar", "site-header", "page-header"}
_COMMENT_WORDS = {"comment", "comments", "reply", "replies"}
#: Words that may stand beside a furniture word in a compound name such as "site-nav"; "has", "page" or "open" are none of them.
_BESIDE = set(
    "site main top bottom left right primary secondary global header box block list item items area bar body section wrapper "
    "container inner posts articles links link buttons button form title slot unit div desktop mobile".split())
_IN_HEAD = set("base basefont bgsound head html link meta title script style noscript noframes template".split())
#: How firmly an element is furniture: a form, by its class or id words, by its element, role or being hidden.
_FORM, _NAMED, _FIRM = 1, 2, 3
_CELLS = {"td", "th"}
#: A start tag ends open elements of the first set, looking up to the second.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "td": (_CELLS, {"tr", "table"}),
    "th": (_CELLS, {"tr", "table"}),
}

_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))"""
    r"""|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)(?:>|\Z)"""
    r"""|</[^a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
_ENDS_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}


def _named(tokens: list[str], known: set[str]) -> bool:
    """Whether a class or id is a known word, or a compound of known words and those that may stand beside them."""
    for token in tokens:
        parts = _WORDS.findall(token)
        if any(x in known for x in parts) and all(x in known or x in _BESIDE or x.isdigit() for x in parts):
            return True
    return False


def _kind(name: str, attrs: str, in_article: bool) -> tuple[int, str]:
    """How firmly an element is page furniture (0: not), and whether it names the "article" or the "main" part."""
    names = {}
    if attrs.strip():
        for m in _ATTR.finditer(attrs):
            names.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    role = names.get("role")
    article = "main" if name == "main" or role == "main" else "article" if name == "article" or role == "article" or "articlebody" in names.get("itemprop", "") else ""
    if name in ("html", "body"):
        return 0, ""
    tokens = (names.get("class", "") + " " + names.get("id", "")).split()
    hidden = "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "")
    if article:
        return _FIRM if hidden or _named(tokens, _COMMENT_WORDS) else 0, article
    if hidden or role in _ROLES or name in _FURNITURE and name != "form" or not in_article and name == "header":
        return _FIRM, ""
    if _named(tokens, _CLASS_WORDS) or not in_article and not _HEADER_WORDS.isdisjoint(tokens):
        return _NAMED, ""
    return _FORM if name == "form" else 0, ""


def lines_of(page: str, trust_articles: bool = False) -> tuple[list[tuple[str, bool, int]], bool]:
    """(text, inside the article, characters in links) of every line, and whether
    an article was left out for the class or id of an element around it.
    Furniture gives empty lines.  A main part and a form's article count
    whatever the names around them; with ``trust_articles`` all articles do."""
    lines: list[tuple[str, bool, int]] = []
    pieces: list[str] = []
    inside = False
    linked = 0
    left_out = False
    stack: list[tuple[str, int, bool, bool, bool]] = []  # name, furniture, article, link, header of the article
    open_names: Counter = Counter()

    def flush(gap: bool = False) -> None:
        nonlocal inside, linked
        if pieces:
            if text := " ".join("".join(pieces).split()):
                lines.append((text, inside, linked))
            pieces.clear()
        inside, linked = False, 0
        if gap:
            lines.append(("", False, 0))

    def pop_to(k: int) -> None:
        for x in stack[k:]:
            open_names[x[0]] -= 1
        del stack[k:]

    def text_from(a: int, b: int) -> None:
        nonlocal inside, linked
        if a >= b:
            return
        if open_names["head"] and stack[-1][0] == "head" and not page[a:b].isspace():
            pop_to(len(stack) - 1)  # text ends an open head
        if stack:
            name, furniture, article, link, head = stack[-1]
            if furniture or head:
                return
        else:
            article = link = False
        piece = page[a:b]
        if "&" in piece:
            piece = _html.unescape(piece)
        pieces.append(piece)
        if piece.strip():
            inside = inside or article
            linked += len(piece.strip()) if link else 0

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text_from(at, end)
            break
        text_from(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        block = name in _BLOCK
        if m[1]:
            if block:
                flush(name in _GAPS)
            elif name in _CELLS:
                pieces.append(" ")
            if open_names[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                pop_to(k)
            continue
        if open_names["head"] and name not in _IN_HEAD:  # as does any element that cannot stand in it
            pop_to(next(k for k, x in enumerate(stack) if x[0] == "head"))
        if name in _RAW:
            if not m[0].endswith("/>") or name in ("script", "style", "textarea", "title"):
                close = _ENDS_RAW[name].search(page, at)
                if close is None:
                    at = end
                else:
                    closing = _TAG.match(page, close.start())
                    at = closing.end() if closing else end
            pieces.append(" ")
            continue
        if block:
            flush(name in _GAPS)
            if open_names["p"]:  # a block ends an open paragraph
                k = len(stack) - 1
                while k >= 0 and stack[k][0] not in _BLOCK and stack[k][0] not in _CELLS:
                    k -= 1
                if k >= 0 and stack[k][0] == "p":
                    pop_to(k)
        if name in _ENDS:
            ends, limit = _ENDS[name]
            if any(open_names[x] for x in ends):
                k = len(stack) - 1
                while k >= 0 and stack[k][0] not in ends and stack[k][0] not in limit:
                    k -= 1
                if k >= 0 and stack[k][0] in ends:
                    pop_to(k)
        if name in _VOID:
            pieces.append(" ")
            continue
        if name in _CELLS:
            pieces.append(" ")
        _, furniture, article, link, head = stack[-1] if stack else ("", 0, False, False, False)
        own, names_article = _kind(name, m[3], article)
        if names_article and not own and not article:
            if furniture <= _FORM or furniture == _NAMED and (trust_articles or names_article == "main"):
                furniture = 0
            left_out = left_out or furniture == _NAMED
        # Inside an article's header only the headings are text of the article.
        head = (head or (article and name == "header")) and name not in _HEADINGS
        stack.append((name, max(furniture, own), article or bool(names_article and not own and not furniture), link or name == "a", head))
        open_names[name] += 1
    flush()
    return lines, left_out


def main_text(page: str | None) -> str:
    """The main text of one page, its blocks joined by newlines.  If the page
    has articles only where names around them say furniture, the longer of
    the texts with and without them."""
    if not page:
        return ""
    lines, left_out = lines_of(page)
    text = _densest(lines)
    if left_out and not any(inside for _, inside, _ in lines):
        text = max(text, _densest(lines_of(page, trust_articles=True)[0]), key=len)
    return text


def _densest(lines: list[tuple[str, bool, int]]) -> str:
    if any(inside for _, inside, _ in lines):
        weight = [len(text) if inside else 0 for text, inside, _ in lines]
        height = 1
    else:
        weight = [0 if 2 * linked > len(text) else len(text) for text, _, linked in lines]
        height = None
    n = len(weight)
    sums, total = [0] * n, 0
    for i in range(n - 1, -1, -1):
        total += weight[i] - (weight[i + WINDOW] if i + WINDOW < n else 0)
        sums[i] = total
    if height is None:
        height = max(1, min(SURGE, max(sums, default=0) // 2))
    kept: list[str] = []
    i = 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        j, top = i, 0
        while j < n and sums[j]:  # from the surge at i to the dive at j
            top = max(top, sums[j])
            j += 1
        if top >= height:
            kept += [lines[k][0] for k in range(i, min(n, j + WINDOW - 1)) if weight[k]]
        i = j
    return "\n".join(kept)


@F.pandas_udf(T.StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> Column:
    """Column with the main text of ``pages[html_col]``; never null."""
    return _main_text(pages[html_col])


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.  One scan, no shuffle."""
    out = pages.select("page_id", "url", extract_main_text(pages).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
