"""Main text of web pages by line-block distribution (operator 3).

Markup is stripped so that each block element is a line of its own, and each edge of a container (``div``, ``section``, lists, tables …)
outside a marked article leaves an empty line. A line's length is the text it has outside links; the markup is an input to it:

* lines of menus, page headers, footers, side bars, notices, adverts, forms and comments, by their elements or names, count a tenth of
  their length and ``FAINT`` at most, so that they never surge;
* where the page marks an article or main part with as much text as any other place has, lines in it count ``SURGE`` characters at
  least, and lines outside it as those off the article;
* text that stands in no paragraph, heading or other element of prose counts ``BARE`` of its length;
* between lines that count and lines that hardly do stand ``WINDOW`` empty lines, so that the windows fall to 0 there.

Lengths are summed over windows of ``WINDOW`` lines. A stretch begins where the sum rises from 0 and ends at its dive point, where it
falls to 0 again; it is text if it surges, that is if the sum reaches ``SURGE`` somewhere in it. Kept is what stands between surge and dive; nothing
else decides. If no stretch surges, the one with the most text that counts is kept.

A form around an article or main part is not off, nor is one that holds nearly all prose of the page (pages that are one form). Words of names that
have other uses too (``widget``, ``related``) name a part only alone or beside words of parts (``related-posts``, not ``related-work``).

Inside a block white space becomes one space; character references are decoded as HTML5 has it; blocks are joined by two line feeds.

Edge cases: null and empty pages give an empty text; cut-off tags, comments and elements run to the end of the page; unclosed
elements end with the element around them; pages of any length are read once, from front to back; ties between stretches go to the
first; repeated rows are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

WINDOW, SURGE, BARE, FAINT = 2, 80, 0.5, 10.0
#: Elements that are never text; elements that begin and end a line; elements without an end tag; elements off the article.
NO_TEXT = "script style template noscript textarea select option svg math iframe object canvas audio video title head".split()
BLOCKS = "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
OFF = "nav header footer aside button menu dialog".split()
FORMS = "form fieldset".split()
#: Words of class, id or role that name such parts.
OFF_WORDS = "ad ads adv advert advertisement advertising adbox banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead cookie cookies consent notice gdpr popup modal overlay newsletter subscribe signup social share sharing related recommended comment comments reply replies disqus widget toolbar pagination pager contentinfo complementary search login".split()
#: Of these, words that also name the layout around an article; first and last words of names that don't name a part.
LAYOUT_WORDS = "banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead social toolbar search login".split()
NOT_FIRST, NOT_LAST = "has with without no not layout page site".split(), "page layout body site template".split()
#: Words that have other uses too, and words beside which they name a part.
TWO_SIDED = "widget related share sharing social recommended side promo promoted reply replies overlay modal popup notice consent subscribe signup complementary toolbar pager search login banner".split()
BESIDE = "post posts article articles link links list lists box boxes bar area section container wrapper wrap block blocks button buttons icon icons item items story stories news content inner outer top bottom left right main primary secondary module panel group row col form to on by the and in a".split()
#: Elements of prose; elements that inside others leave an empty line at their edges.
PROSE = "p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt figcaption caption td th summary".split()
CONTAINERS = "article aside center details dialog dir div dl fieldset figure footer form header hgroup hr main menu nav ol section table ul".split()
_FORMS, _TWO_SIDED, _BESIDE = map(frozenset, (FORMS, TWO_SIDED, BESIDE))
_NO_TEXT, _BLOCKS, _VOID, _OFF, _OFF_WORDS, _LAYOUT, _NOT_FIRST, _NOT_LAST, _PROSE, _CONTAINERS = map(frozenset, (NO_TEXT, BLOCKS, VOID, OFF, OFF_WORDS, LAYOUT_WORDS, NOT_FIRST, NOT_LAST, PROSE, CONTAINERS))
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


@dataclass
class Line:
    text: str
    linked: int  # characters in links
    off: bool  # by the markup around it, forms aside
    form: bool
    inside: bool  # of a marked article
    prose: bool
    edges: int  # of containers, since the line before


def off_words(names: str) -> set[str]:
    """The words of class, id and role values that name a part off the article; ``has-sidebar`` or ``search-page`` name none."""
    found = set()
    for name in names.split():
        words = _WORDS.findall(name)
        if words and (name in _OFF_WORDS or words[0] not in _NOT_FIRST and words[-1] not in _NOT_LAST):
            own = _OFF_WORDS.intersection(words)
            found |= own if own and (not own <= _TWO_SIDED or all(w in _OFF_WORDS or w in _BESIDE for w in words)) else set()
    return found


def lines_of(page: str) -> list[Line]:
    lines: list[Line] = []
    buffer: list[str] = []
    stack: list[tuple] = []  # of open elements: name, and what held around them
    linked = edges = at = 0
    open_at: dict[str, list[int]] = {}  # places in the stack by name, so that an end tag finds its element at once
    barriers: list[int] = []  # of articles, main parts and the body, beyond which other end tags don't reach
    endless: set[str] = set()  # elements of which no further end tag follows
    # Depths: elements off the article; forms; off by a name; off by a name of the layout; marked articles; links; prose.
    off = forms = named_off = layout_off = inside = anchors = prose = 0

    def flush() -> None:
        nonlocal linked, edges
        text = " ".join("".join(buffer).split())
        if text:
            lines.append(Line(text, linked, off + named_off + layout_off > 0, forms > 0, inside > 0, prose > 0, edges))
            edges = 0
        buffer.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = references.unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if anchors:
                linked += len(text.strip())

    def leave() -> None:
        nonlocal off, forms, named_off, layout_off, inside, anchors, prose
        name, off, forms, named_off, layout_off, inside, anchors, prose = stack.pop()
        open_at[name].pop()
        if barriers and barriers[-1] == len(stack):
            barriers.pop()

    size = len(page)
    while at < size:
        tag = _TOKEN.search(page, at)
        if tag is None:
            add(page[at:])
            break
        add(page[at : tag.start()])
        at = tag.end()
        if not tag[2]:
            continue
        name = tag[2].lower()
        if name == "br":
            buffer.append(" ")
            continue
        if name in _BLOCKS:
            flush()
            edges += name in _CONTAINERS and not inside
        if tag[1]:
            if open_at.get(name) and (not barriers or barriers[-1] <= open_at[name][-1] or name in ("body", "html")):
                below = open_at[name][-1]
                while len(stack) > below:
                    leave()
            continue
        if name in _NO_TEXT:
            if not tag[3].endswith("/"):
                end = None if name in endless else _end_of(name).search(page, at)
                if end is None:
                    endless.add(name)
                at = end.end() if end else (at if name == "head" else size)
            buffer.append(" ")
            continue
        if name in _VOID or tag[3].endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
            leave()
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(tag[3])).lower() if tag[3] else ""
        is_article = name in ("article", "main")
        words = off_words(names) if names and name not in ("body", "html") else set()
        comment = is_article and not {"comment", "comments", "reply"}.isdisjoint(words)
        is_off = name in _OFF or comment or "hidden" in tag[3].lower().split() or 'aria-hidden="true"' in tag[3]
        open_at.setdefault(name, []).append(len(stack))
        if is_article or name == "body":
            barriers.append(len(stack))
        stack.append((name, off, forms, named_off, layout_off, inside, anchors, prose))
        if is_article and not comment:  # an article is one whatever the form and the layout around it, and so is a main part whatever the names
            forms, layout_off, inside = 0, 0, inside + 1
            named_off = 0 if name == "main" else named_off
        elif words:
            named_off, layout_off = named_off + bool(words - _LAYOUT), layout_off + (words <= _LAYOUT)
        off, forms, anchors, prose = off + is_off, forms + (name in _FORMS), anchors + (name == "a"), prose + (name in _PROSE)
    flush()
    return lines


@cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I)


def off_lines(lines: list[Line]) -> list[bool]:
    """Which lines are off the article. Forms are, unless they hold three times as much prose as all that isn't off."""
    size = lambda x: len(x.text) if x.prose else 0
    in_forms, others = sum(size(x) for x in lines if x.form and not x.off), sum(len(x.text) for x in lines if not x.form and not x.off)
    whole = in_forms >= SURGE and in_forms > 3 * others
    return [x.off or x.form and not whole for x in lines]


def lengths(lines: list[Line]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of all lines in page order, with the empty ones between them; where the lines of text stand in that row; and which of them count."""
    off = off_lines(lines)
    plain = [0 if o else len(x.text) - min(x.linked, len(x.text)) for x, o in zip(lines, off)]
    weighed = np.array([n * (1 if x.prose else BARE) for n, x in zip(plain, lines)])
    inside = np.array([x.inside for x in lines])
    gaps = np.array([min(x.edges, WINDOW) for x in lines])
    there = np.cumsum(gaps + 1) - 1
    outside = np.zeros(there[-1] + 1)
    outside[there] = np.where(inside, 0, weighed)
    marked = any(i and not o for i, o in zip(inside, off)) and sum(n for n, i in zip(plain, inside) if i) >= max((outside[a:b].sum() for a, b in stretches(outside)), default=0)
    counts = ~np.array(off) & (inside if marked else True)
    faint = np.minimum(FAINT, [len(x.text) / 10 for x in lines])
    weighed = np.where(counts, np.maximum(SURGE, plain) if marked else weighed, faint)
    turns = np.diff(counts.astype(np.int8), prepend=counts[:1].astype(np.int8)) != 0
    if marked:
        gaps[counts] = 0  # an article is one, whatever containers it has
    places = np.cumsum(np.where(turns, WINDOW, gaps) + 1) - 1
    row = np.zeros(places[-1] + 1)
    row[places] = weighed
    return row, places, counts


def windows(row: np.ndarray) -> np.ndarray:
    """sums[i]: of the window that ends at line i; the last windows go beyond the end."""
    return np.convolve(row, np.ones(WINDOW))


def stretches(row: np.ndarray) -> list[tuple[int, int]]:
    """(first line, line after the last) of all places where the windows' sum is above 0."""
    above = np.flatnonzero(np.diff(np.concatenate([[0], windows(row) > 0, [0]]).astype(np.int8)))
    return [(int(a), min(int(b) - WINDOW + 1, len(row))) for a, b in zip(above[::2], above[1::2])]


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    if not lines:
        return ""
    row, places, counts = lengths(lines)
    sums, found = windows(row), stretches(row)
    text = np.zeros(len(row), bool)
    text[places[counts]] = True
    surging = [sums[a : b + WINDOW - 1].max() >= SURGE for a, b in found]
    kept = [r for r, s in zip(found, surging) if s]
    if not kept:
        kept = sorted((r for r in found if text[r[0] : r[1]].any()), key=lambda r: (-row[r[0] : r[1]].sum(), r[0]))[:1]
    if not kept:
        return ""
    which = np.searchsorted([a for a, _ in kept], places, "right") - 1
    return "\n\n".join(x.text for x, p, k in zip(lines, places, which) if k >= 0 and p < kept[k][1])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return map_batches(pages, ["page_id", "url", "html"], run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
