"""A page's main text by the density of words and links in its blocks."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "title", "select", "button", "textarea", "svg"}
INLINE = {"a", "abbr", "b", "bdi", "cite", "code", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "var"}
#: Elements whose text isn't the page's own, and words in a class or id that say so.
BESIDE = {"nav", "footer", "header", "aside", "form", "table", "figcaption", "dialog"}
BESIDE_NAMES = re.compile(r"(?<![a-z])(ad|ads|advert\w*|banner|breadcrumbs?|comments?|comment-?list|cookies?|disqus|menu|nav|navbar|newsletter|pagination|popup|promo\w*|related|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|tags|toolbar|widgets?)(?![a-z])", re.I)
WHOLE = {"html", "body", "main", "article"}
RUNNING = {"p", "blockquote", "pre", "dd"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of a block that speak for running text whatever its element, and what any other block must make up for.
LONG, COST = 15, 4


class Block(NamedTuple):
    text: str
    tag: str
    words: int
    linked: int  # of its words, those inside links


class _Blocks(HTMLParser):
    """Text cut where block elements and line breaks are, without what stands beside the page's own text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.parts: list[tuple[str, bool]] = []
        self.blocks: list[Block] = []
        self.beside = self.links = 0

    def _tag(self) -> str:
        return next((t for t, _ in reversed(self.open) if t not in INLINE), "")

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(t for t, _ in self.parts)).strip()
        if text:
            self.blocks.append(Block(text, self._tag(), len(text.split()), len("".join(t if linked else " " for t, linked in self.parts).split())))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br" and self._tag() in RUNNING | HEADINGS:  # a line of the same paragraph
            self.handle_data(" ")
            return
        if tag not in INLINE:
            if tag not in VOID | SILENT and self._tag() in {"p", *HEADINGS}:  # a paragraph ends where the next block begins
                self.handle_endtag(self._tag())
            self.flush()
        if tag not in VOID:
            a = dict(attrs)
            names = f"{a.get('class') or ''} {a.get('id') or ''}"
            away = tag in BESIDE or tag in SILENT or (tag not in WHOLE and BESIDE_NAMES.search(names) is not None)
            self.open.append((tag, away))
            self.beside += away
            self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        if tag not in INLINE:
            self.flush()
        while self.open:
            t, away = self.open.pop()
            self.beside -= away
            self.links -= t == "a"
            if t == tag:
                break

    def handle_data(self, data):
        if not self.beside:
            self.parts.append((data, self.links > 0))


def blocks(html: str | None) -> list[Block]:
    page = _Blocks()
    page.feed(html or "")
    page.close()
    page.flush()
    return page.blocks


def _running(b: Block) -> bool:
    """Whether a block is running text by itself: a paragraph, or long, and less than a third of it linked."""
    return 3 * b.linked < b.words and (b.tag in RUNNING or b.words - b.linked >= LONG)


def _kept(rows: list[Block]) -> list[bool]:
    """Running text; a heading with running text right below it; another mostly plain block with running text on both sides."""
    good = [_running(b) for b in rows]
    fair = [2 * b.linked < b.words for b in rows]
    below, above, after = [False] * len(rows), False, False
    for i in reversed(range(len(rows))):
        below[i], after = after, good[i] or (after and fair[i])
    out = []
    for b, g, f, under in zip(rows, good, fair, below, strict=True):
        out.append(g or (f and under and (above or b.tag in HEADINGS)))
        above = g or (above and f)
    return out


def body_text(html: str | None) -> str | None:
    """The main text of a page, a line a block; null without any.

    Precision before recall: blocks inside navigation, headers, footers, tables,
    comments and the like never count. A block that is kept is worth its plain words, any
    other block its plain words less twice its linked ones and less COST. The
    text is the stretch of blocks worth most, less what is in it by links or
    scraps: menus and lists of links between texts end it, single ones don't. A
    title (h1) that only links and scraps part from it comes before it.
    """
    rows = blocks(html)
    kept = _kept(rows)
    best, first, last, total, start = 0, 0, 0, 0, 0
    for i, (b, k) in enumerate(zip(rows, kept, strict=True)):
        total += b.words - b.linked - (0 if k else 2 * b.linked + COST)
        if total > best:
            best, first, last = total, start, i + 1
        elif total < 0:
            total, start = 0, i + 1
    lines = [b.text for b, k in zip(rows[first:last], kept[first:last], strict=True) if k]
    before = next((i for i in reversed(range(first)) if rows[i].tag == "h1" or kept[i]), None)
    if lines and before is not None and rows[before].tag == "h1":
        lines.insert(0, rows[before].text)
    return "\n".join(lines) or None
