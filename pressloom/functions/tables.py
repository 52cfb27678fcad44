"""Table functions to call from SQL, beside LATERAL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from pressloom.functions.html import found_links, read
from pressloom.functions.segments import END, MOST, TAIL, TARGET

_ENDS = re.compile(END)


@udtf(returnType="pos int, url string, title string")
class PageLinks:
    """page_links(html, base): every link that a page shows, in order; none for null."""

    def eval(self, html: str, base: str) -> Iterator[tuple[int, str, str]]:
        for x in found_links(html, base):
            yield x["pos"], x["url"], x["title"]


@udtf(returnType="pos int, line string")
class PageLines:
    """page_lines(html): every paragraph of a page with a place, wherever it stands; none for null."""

    def eval(self, html: str) -> Iterator[tuple[int, str]]:
        for pos, (line, _) in enumerate(read(html).paragraphs):
            yield pos, line


@udtf(returnType="segment int, start double, text string")
class TranscriptSegments:
    """transcript_segments(cues): the blocks of an array<struct<t, text>>, as segments.segments makes them; none for null."""

    def eval(self, cues: list[Row]) -> Iterator[tuple[int, float, str]]:
        blocks: list[tuple[float, str]] = []
        start, words, n = 0.0, [], 0
        for c in cues or []:
            size = len(c.text) + 1
            if n and n + size > MOST:
                blocks.append((start, " ".join(words)))
                words, n = [], 0
            if not n:
                start = c.t or 0.0
            words.append(c.text)
            n += size
            if n >= TARGET and _ENDS.search(c.text):
                blocks.append((start, " ".join(words)))
                words, n = [], 0
        if n:
            blocks.append((start, " ".join(words)))
        if len(blocks) > 1 and len(blocks[-1][1]) < TAIL:
            (start, text), (_, tail) = blocks[-2:]
            blocks[-2:] = [(start, f"{text} {tail}")]
        for i, (start, text) in enumerate(blocks):
            yield i, start, text


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session's SQL."""
    spark.udtf.register("page_links", PageLinks)
    spark.udtf.register("page_lines", PageLines)
    spark.udtf.register("transcript_segments", TranscriptSegments)
