"""What landed pages hold: links, main text, posts, authors, dates. The standard parser, in pandas UDFs; rules stay Columns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.functions.blocks import body_text
from pressloom.functions.columns import article_url, bad_author, clean_author, iso_time, text_date, url_date

_TEXT = T.StringType()
_LINK = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("url", _TEXT), T.StructField("title", _TEXT)])
_POST = T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("text", _TEXT)])
_DATES = T.StructType([T.StructField(n, _TEXT) for n in ("jsonld", "meta", "time", "text")])
_AUTHORS = T.StructType([T.StructField(n, T.ArrayType(_TEXT)) for n in ("named", "signed")])
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "noscript", "template"}
_BLOCK = {"p", "div", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "br", "header", "footer", "nav", "aside", "ul", "ol", "table"}
#: Where a line of running text ends besides: no name goes on beyond it.
_ENDS = _BLOCK | {"title", "body", "main", "td", "th", "dl", "dt", "dd", "blockquote", "pre", "address", "figure", "figcaption", "form", "button", "option", "hr"}


class _Page(HTMLParser):
    """One pass: elements with their attributes and texts, and the JSON-LD scripts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict, list[str]]] = []
        self.found: list[tuple[str, dict, str]] = []
        self.paragraphs: list[tuple[str, set[str]]] = []
        self.scripts: list[str] = []
        self.lines: list[list[str]] = [[]]
        self.blocks: list[list[str]] = []

    def _in_paragraph(self) -> bool:
        """Whether a paragraph is open below inline elements only, such as a bold one that is never closed."""
        return next((t == "p" for t, _, _ in reversed(self.open) if t in _BLOCK), False)

    def _line_ends(self, tag: str) -> None:
        if tag in _ENDS:
            self.lines.append([])

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self._line_ends(tag)
        if tag in _BLOCK and tag != "br" and self._in_paragraph():  # a paragraph ends where the next block begins
            self.handle_endtag("p")
        if tag in _VOID:
            self.found.append((tag, a, ""))
        else:
            self.open.append((tag, a, []))
            if tag in ("p", "div", "span", "small"):
                self.blocks.append(self.open[-1][2])

    def handle_startendtag(self, tag, attrs):
        self._line_ends(tag)
        self.found.append((tag, {k: v or "" for k, v in attrs}, ""))

    def handle_endtag(self, tag):
        self._line_ends(tag)
        if not any(t == tag for t, _, _ in self.open):
            return
        while self.open:
            t, a, parts = self.open.pop()
            text = re.sub(r"\s+", " ", "".join(parts)).strip()
            self.found.append((t, a, text))
            if t in ("p", "h1", "h2", "h3", "li", "blockquote") and text:
                self.paragraphs.append((text, {x for x, _, _ in self.open}))
            if t == tag:
                break

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "script":
            if "ld+json" in self.open[-1][1].get("type", ""):
                self.scripts.append(data)
            return
        if any(t in _SILENT for t, _, _ in self.open):
            return
        self.lines[-1].append(data)
        for _, _, parts in self.open:
            parts.append(data)


def read(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    while page.open:  # what a cut page left open
        page.handle_endtag(page.open[-1][0])
    return page


def found_links(html: str | None, base: str | None) -> list[dict]:
    """pos, url, title of every link that a page shows, in order."""
    out = []
    for tag, a, text in read(html).found:
        if tag == "a" and a.get("href"):
            try:
                url = urljoin(base or "", a["href"]).split("#")[0].rstrip("/")
            except ValueError:
                continue
            out.append({"pos": len(out), "url": url, "title": (text or a.get("aria-label", "") or a.get("title", "")).strip()[:300]})
    return out


@F.pandas_udf(T.ArrayType(_LINK))
def _links(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([found_links(h, b) for h, b in zip(html, base, strict=True)])


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, url, title, article: the first link to each address that a landed page (page_id, url, html) shows, and whether it looks like an article of that host."""
    return first_links(pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), F.inline(_links("html", "url"))))


def first_links(rows: DataFrame) -> DataFrame:
    """Of rows of page_id, host, pos, url, title: the first of each page and address, and whether it looks like an article."""
    first = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("pos"))
    return rows.withColumn("r", first).filter("r = 1").select("page_id", "pos", "url", "title", article_url(F.col("url"), F.col("host")).alias("article"))


def article_links(pages: DataFrame) -> DataFrame:
    return links(pages).filter("article").drop("article")


@F.pandas_udf(_TEXT)
def main_text(html: pd.Series) -> pd.Series:
    """The main text of a page by density, a line each block; null if there is none."""
    return html.map(body_text, na_action="ignore").astype(object)


@F.pandas_udf(T.ArrayType(_POST))
def _posts(html: pd.Series) -> pd.Series:
    def one(h):
        texts = [t for tag, a, t in read(h).found if "message_text" in a.get("class", "") and t]
        return [{"ordinal": i, "text": t} for i, t in enumerate(texts)]

    return pd.Series([one(h) for h in html])


def channel_posts(pages: DataFrame, least: int = 50) -> DataFrame:
    """source_name, ordinal, text of a channel's preview page, long enough, one for each beginning."""
    rows = pages.select("source_name", F.inline(_posts("html"))).filter(F.length("text") >= least)
    return longest_by_prefix(rows)


def longest_by_prefix(posts: DataFrame, prefix: int = 80) -> DataFrame:
    """Of a source's posts with the same beginning the longest, the first of those as long."""
    key = F.left("text", F.lit(prefix))
    rank = F.row_number().over(Window.partitionBy("source_name", key).orderBy(F.length("text").desc(), "ordinal"))
    return posts.withColumn("__r", rank).filter("__r = 1").drop("__r")


def _people(data) -> Iterator[str]:
    """Names of authors that are persons, in JSON-LD of any nesting."""
    for item in data if isinstance(data, list) else [data]:
        if not isinstance(item, dict):
            continue
        yield from _people(item.get("@graph", []))
        author = item.get("author") or []
        for a in author if isinstance(author, list) else [author]:
            if isinstance(a, str):
                yield a
            elif isinstance(a, dict) and a.get("@type", "Person") == "Person" and a.get("name"):
                yield str(a["name"])


def _json(scripts: list[str]) -> Iterator:
    for s in scripts:
        try:
            yield json.loads(s)
        except ValueError:
            continue


# Elements that hold an author, in order of trust: tag, attribute, its value (a pattern for class), and whether the content attribute counts.
AUTHOR_PLACES = [
    ("meta", "name", "author"), ("meta", "property", "article:author"), ("span", "itemprop", "author"), ("div", "itemprop", "author"), ("a", "itemprop", "author"), ("a", "rel", "author"), ("a", "class", "author"), ("span", "class", "author"), ("p", "class", "author"), ("div", "class", "author"),
    ("span", "class", "byline"), ("div", "class", "byline"), ("p", "class", "byline"), ("span", "class", "writer|signature|posted-by"), ("div", "class", "td-post-author-name"), ("span", "class", "td-post-author-name"), ("span", "class", "entry-author|posted-on"), ("meta", "name", "twitter:creator"), ("meta", "name", "twitter:data1"),
]
# Elements that hold a publication date, in order of trust.
DATE_PLACES = ["article:published_time", "datePublished", "og:published_time", "pubdate", "publishdate", "date", "DC.date.issued", "sailthru.date", "parsely-pub-date"]


# What names after 'by' and signatures of the agency look like.
_LETTERS = "[A-ZÉÈÊÀÂÔÇа-яёА-ЯЁa-zéèêàâôç]+"
_BYLINE = re.compile(rf"\b(?:par|by|автор:?)\s+({_LETTERS}(?:[\s\-]{_LETTERS}){{0,4}})", re.I)
_NAME = r"[A-ZÉÈÊÀÂÔÇ][A-ZÉÈÊÀÂÔÇa-zéèêàâôç\-']{2,}"
_SIGNATURE = re.compile(rf"\b({_NAME}(?: {_NAME}){{0,3}})\s*/\s*AGP\b")


def _spaced(parts: list[str]) -> str:
    return " ".join(x.strip() for x in parts if x.strip())


def _bylines(page: _Page) -> list[str]:
    """Names after 'by' in short elements among a page's first 20 (the rule's own bound: it looks at the beginning)."""
    texts = [t for t in map(_spaced, page.blocks[:20]) if 4 <= len(t) <= 300]
    return [m.strip() for t in texts for m in _BYLINE.findall(t) if 5 <= len(m.strip()) <= 50 and " " in m.strip()]


def _signatures(page: _Page) -> list[str]:
    """Names that sign for the agency AGP, those in the last 1500 characters first; words of the block before belong to no name."""
    text = "\n".join(x for x in (re.sub(r"\s+", " ", _spaced(line)) for line in page.lines) if x)
    found = [(m.start(), m[1]) for m in _SIGNATURE.finditer(text)]
    return [name for at, name in found if at >= len(text) - 1500] + [name for _, name in found]


@F.pandas_udf(_AUTHORS)
def _author_candidates(html: pd.Series) -> pd.DataFrame:
    def one(h):
        page = read(h)
        out = [n for d in _json(page.scripts) for n in _people(d)]
        for tag, attr, value in AUTHOR_PLACES:
            for t, a, text in page.found:
                if t == tag and (re.search(value, a.get(attr, ""), re.I) if attr == "class" else a.get(attr) == value):
                    out.append(a.get("content", "") if tag == "meta" else text)
        return [x for x in out + _bylines(page) if x], _signatures(page)

    return pd.DataFrame([one(h) for h in html], columns=["named", "signed"])


def page_author(html: Column, source: Column) -> Column:
    """The first candidate that, cleaned, names a person: JSON-LD, elements, 'by X', the signature at the end; the signature first where the source is its agency."""
    c = _author_candidates(html)
    own = F.contains(F.lower(source), F.lit("agp"))
    cleaned = F.transform(F.when(own, F.concat(c["signed"], c["named"])).otherwise(F.concat(c["named"], c["signed"])), clean_author)
    return F.get(F.filter(cleaned, lambda a: a.isNotNull() & ~bad_author(a, source)), F.lit(0))


@F.pandas_udf(_DATES)
def _date_candidates(html: pd.Series) -> pd.DataFrame:
    def one(h):
        page = read(h)
        found = [str(x.get(k)) for d in _json(page.scripts) for x in (d if isinstance(d, list) else d.get("@graph", [d]) if isinstance(d, dict) else []) if isinstance(x, dict) for k in ("datePublished", "dateCreated") if x.get(k)]
        first = [t for tag, _, t in page.found if tag in ("p", "div", "span", "time", "small", "header")][:30]  # the rule's own bound: it looks at the beginning
        metas = {a.get("property") or a.get("name") or a.get("itemprop"): a.get("content") for t, a, _ in page.found if t == "meta"}
        return found[0] if found else None, next((metas[k] for k in DATE_PLACES if metas.get(k)), None), next((a["datetime"] for t, a, _ in page.found if t == "time" and a.get("datetime")), None), " | ".join(t for t in first if 4 < len(t) < 200) or None

    return pd.DataFrame([one(h) for h in html], columns=["jsonld", "meta", "time", "text"])


def page_date(html: Column, url: Column, fallback: Column | None = None) -> Column:
    """struct<dt, method>: the publication time by JSON-LD, metas, <time>, text, address, fallback, in that order."""
    c = _date_candidates(html)
    ways = [("jsonld", iso_time(c["jsonld"])), ("meta", iso_time(c["meta"])), ("time", iso_time(c["time"])), ("text", text_date(c["text"])), ("url", url_date(url))]
    ways += [("fetched", fallback)] if fallback is not None else []
    return F.coalesce(*[F.when(dt.isNotNull(), F.struct(dt.alias("dt"), F.lit(m).alias("method"))) for m, dt in ways])
