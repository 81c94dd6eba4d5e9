"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block of the page. Where an element holds blocks its start and
its end leave an empty line each; elements that are never article text (scripts, menus, forms, adverts,
comment sections, ...) leave an empty line too. A line block is ``WINDOW`` successive lines, its size
their text outside links. Text surges where a block reaches the threshold, and dives at the empty line
behind the last such block; what stands between is kept, with short lines inside, unless a block
without text outside links parts it. The threshold is the page's largest block over ``RATIO``, so a short article is
judged by its own page. Where a page has an ``article`` (else a ``main``) element the lines outside it
are emptied, and any text outside links surges: within it only runs that are links alone fall away.

Defined cases: a null or empty page, or one with no main text, gives an empty text; unclosed and
truncated markup is closed at its parent or the end; ``br`` is white space; all Unicode white space
counts; equal blocks all surge; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import in_batches

#: Lines summed in a line block; how many times larger than the threshold the largest block of a page is.
WINDOW, RATIO = 3, 3
#: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HOLDERS = frozenset("article aside blockquote body center details dialog dir div dl fieldset figure footer form header main menu nav ol optgroup section table ul".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements, roles and words of class or id that mark what isn't article text.
NEVER = frozenset("head script style noscript template svg math nav aside footer form button select textarea iframe object canvas dialog menu label input audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent comment comments respond disqus newsletter related recommended share sharing social popup modal promo breadcrumb breadcrumbs pagination teaser".split())
WEAK = frozenset("sidebar nav navbar navigation menu footer header masthead banner notice notices alert widget toolbar login signup subscribe overlay topbar".split())
ARTICLE_WORDS = frozenset("article post entry content main body story text page wrapper container layout".split())

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Which open elements the start of an element closes, up to the boundary behind the bar.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P_BOUNDARY = frozenset("button td th caption table body html".split())


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element isn't article text."""
    if tag in NEVER or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("body", "html"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    words = {w.lower() for w in _WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    if words & STRONG:
        return not (tag in ("article", "main") and words & ARTICLE_WORDS and not words & {"comment", "comments"})
    return bool(words & WEAK) and not words & ARTICLE_WORDS and tag not in ("article", "main") and not re.fullmatch("h[1-6]", tag)


class Lines:
    """The lines of a page: text, characters outside links, and whether an article or main element holds it."""

    def __init__(self, page: str) -> None:
        self.rows: list[tuple[str, int, bool, bool]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.stack: list[str] = []
        self.open: Counter[str] = Counter()
        self.places: dict[str, list[int]] = {}  # depths of the open elements by tag
        self.skip = 0  # depth of the element that is skipped, and all it holds
        self._read(page)

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            self.rows.append((text, max(len(text) - self.linked, 0), self.open["article"] > 0, self.open["main"] > 0))
        self.parts, self.linked = [], 0

    def _gap(self) -> None:
        self.rows.append(("", 0, self.open["article"] > 0, self.open["main"] > 0))

    def _pop(self, depth: int) -> None:
        """Closes elements down to ``depth`` open ones."""
        while len(self.stack) > depth:
            tag = self.stack.pop()
            if tag in BLOCKS and not self.skip:
                self._flush()
                if tag in HOLDERS:
                    self._gap()
            if len(self.stack) < self.skip:
                self.skip = 0
            self.open[tag] -= 1
            self.places[tag].pop()

    def _push(self, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(tag)
        self.open[tag] += 1

    def _close(self, tags: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        """Closes the outermost of ``tags`` above the nearest of ``until``."""
        if not any(self.open[t] > 0 for t in tags):
            return
        at = None
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] in until:
                break
            if self.stack[k] in tags:
                at = k
        if at is not None:
            self._pop(at)

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "body" and self.open["head"] > 0:
            self._close({"head"}, frozenset())
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag in BLOCKS and self.open["p"] > 0:
            self._close({"p"}, _P_BOUNDARY)
        if self.skip:
            if tag not in VOID:
                self._push(tag)
            return
        if tag in BLOCKS:
            self._flush()
            if tag in HOLDERS:
                self._gap()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if _unwanted(tag, attributes, self.open["article"] > 0):
            if tag in BLOCKS - HOLDERS or tag == "head":
                self._flush()
                self._gap()
            self.skip = len(self.stack) + 1
        self._push(tag)

    def _text(self, text: str) -> None:
        if text and not self.skip:
            self.parts.append(text)
            if self.open["a"] > 0:
                self.linked += len(text)

    def _read(self, page: str) -> None:
        at = 0
        while m := _TAG.search(page, at):
            self._text(page[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if self.open[tag] > 0:
                    self._pop(self.places[tag][-1])
                continue
            if m[5] and not m[0].endswith(">"):
                break
            self._start(tag, m[3] or m[6] or "")
            if tag in RAW and self.open[tag] > 0:
                end = re.compile(f"</{tag}[^>]*(?:>|\\Z)", re.I).search(page, at)
                self._text("" if tag in NEVER else page[at : end.start() if end else len(page)])
                at = end.end() if end else len(page)
                self._pop(len(self.stack) - 1)
        else:
            self._text(page[at:])
        self._pop(0)
        self._flush()


def surges(texts: list[str], sizes: list[int], threshold: float, bounded: bool) -> list[tuple[int, int]]:
    """``[surge, dive)`` line ranges; lines of links alone at their ends stay if ``bounded`` and next to other text."""
    n, inside = len(texts), bytearray(len(texts))
    for k in range(n):
        if sizes[k] and sum(sizes[k : k + WINDOW]) >= threshold:
            inside[k : k + WINDOW] = b"\1" * len(inside[k : k + WINDOW])
    for k in range(n):
        if not inside[k] and sizes[k] and sum(sizes[max(k - WINDOW + 1, 0) : k + 1]) >= threshold:
            inside[k] = 1
    out: list[list[int]] = []
    k = 0
    while k < n:
        if not (inside[k] and sizes[k]):
            k += 1
            continue
        start = end = k
        while start and (texts[start - 1] if bounded else sizes[start - 1]):
            start -= 1
        while end + 1 < n and (sizes[end + 1] or (bounded or inside[end + 1]) and texts[end + 1]):
            end += 1
        while not bounded and not sizes[end]:
            end -= 1
        if out and all(any(sizes[i : i + WINDOW]) for i in range(out[-1][1], start - WINDOW + 1)):
            out[-1][1] = end + 1
        else:
            out.append([start, end + 1])
        k = end + 1
    return [(a, b) for a, b in out]


def main_text(page: str | None) -> str:
    """The article's blocks, joined by newlines."""
    if not page:
        return ""
    rows, bounded = Lines(page).rows, False
    for held in (2, 3):
        if any(r[held] and r[0] for r in rows):
            rows, bounded = [r if r[held] else ("", 0, False, False) for r in rows], True
            break
    texts, sizes = [r[0] for r in rows], [r[1] for r in rows]
    largest = max((sum(sizes[k : k + WINDOW]) for k in range(len(sizes))), default=0)
    threshold = 1 if bounded else max(largest / RATIO, 1)
    return "\n".join(t for a, b in surges(texts, sizes, threshold, bounded) for t in texts[a:b] if t)


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return in_batches(pages).select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
