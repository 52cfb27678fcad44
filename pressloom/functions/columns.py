"""Scalar columns over articles: identity, counts, folding, dates, authors, filters on text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_id(kind: Column, url: Column, row_id: Column) -> Column:
    """The unit that a segment belongs to: the video in its address, else the row itself."""
    return F.when(kind == "youtube", F.regexp_extract(url, "v=([A-Za-z0-9_-]+)", 1)).when(kind == "tv", F.regexp_extract(url, "video/([A-Za-z0-9]+)", 1)).otherwise(row_id)


def offset_seconds(url: Column) -> Column:
    """Where in its video a segment begins; null without a mark."""
    return F.regexp_extract(url, r"[?&#]t=(\d+)", 1).try_cast("int")


def word_count(text: Column) -> Column:
    """Blanks and one."""
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def block(media_type: Column) -> Column:
    return F.when(media_type.isin("etat", "para_etat"), "aligne_etat").otherwise("independant_exil")


def url_hash(url: Column) -> Column:
    return F.left(F.sha2(url, 256), F.lit(16))


def _folding() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks whose decomposition is one letter and marks, and that letter."""
    pairs = {}
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        ch = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if plain != ch and len(plain) == 1:
            pairs[ch] = plain
    return "".join(pairs), "".join(pairs.values())


_MARKED, _PLAIN = _folding()


def fold(text: Column) -> Column:
    """Without accents."""
    return F.translate(text, _MARKED, _PLAIN)


def fold_literal(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def strip_part(title: Column) -> Column:
    """A segment's title without its [i/n]."""
    return F.regexp_replace(title, r" \[\d+/\d+\]$", "")


def first_line(text: Column, most: int = 120) -> Column:
    """A post's first line as its title; the text's beginning if that line is blank."""
    line = F.left(F.trim(F.split_part(text, F.lit("\n"), F.lit(1))), F.lit(most))
    return F.when(F.length(line) > 0, line).otherwise(F.left(text, F.lit(most)))


def excerpt(text: Column, most: int = 250) -> Column:
    return F.left(text, F.lit(most))


def long_enough(content: Column, kind: Column) -> Column:
    """Enough text to be analysed: 300 characters, 50 for a telegram post."""
    n = F.length(content)
    return content.isNotNull() & (((kind == "telegram") & (n >= 50)) | ((kind != "telegram") & (n >= 300)))


def eligible(content: Column, kind: Column, language: Column, wanted: str = "ru") -> Column:
    """Enough text in the wanted language to be analysed."""
    return long_enough(content, kind) & (language == wanted)


def week_of(ts: Column) -> Column:
    """The Monday of a day's week."""
    return F.date_trunc("week", ts).cast("date")


def period(ts: Column, grain: str) -> Column:
    return F.date_trunc(grain, ts).cast("date")


def share(n: Column, total: Column, digits: int = 6) -> Column:
    return F.round(100.0 * n.cast("double") / F.nullif(total.cast("double"), F.lit(0.0)), digits)


def clamp(value: Column, low: float, high: float, default: float = 0.0) -> Column:
    """A number held within bounds; what isn't a number becomes the default."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("double"), F.lit(default))))


def lenient_json(text: Column) -> Column:
    """The outermost braces of a reply as JSON text, code fences and talk around them left out; null if there are none."""
    found = F.regexp_extract(F.regexp_replace(text, "```(json)?", ""), r"(?s)\{.*\}", 0)
    return F.when(F.length(found) > 0, found)


# Patterns of strings that stand in an author field but name no person.
BAD_AUTHOR = [
    r"^(la\s+)?(redaction|rédaction|redac[\s\-]*chef|redac[\s\-]*ch?ef)\s*$",
    r"modérateur|moderateur",
    r"^admin$|^administrateur$",
    r"^unknown\b",
    r"noreply|no-reply",
    r"^info\d+(\.com)?$",
    r"^@\w+$",
    r"^(notre|la)?\s*(team|equipe|équipe|staff)\s*$",
    r"^auteur(s)?\s*$",
    r"^webmaster$",
    r"^tass$|^ria$|^interfax$|^reuters$|^ap$",
    r"^редакция$",
    r"\b(inc|llc|ltd|corp|gmbh|ооо|зао|пао)\.?\s*$",
]
# Outlets that sign with their own name.
ORGANISATIONS = ["ведомости", "риа новости", "риа новости спорт", "rt на русском", "медиазона", "телеканал дождь", "тасс", "известия", "коммерсантъ", "коммерсант", "рбк", "независимая газета", "комсомольская правда", "медуза", "meduza", "новая газета", "новая газета европа", "the bell", "проект", "спутник", "первый канал", "вести", "вгтрк", "the insider", "важные истории"]


def bad_author(author: Column, source: Column) -> Column:
    """Whether an author field names no person: blank, a handle, a desk, an outlet, the source itself, or of an odd length."""
    t = F.trim(author)
    low, src = F.lower(t), F.lower(F.trim(source))
    bad = F.coalesce(t, F.lit("")) == ""
    for pattern in BAD_AUTHOR:
        bad = bad | t.rlike(f"(?iu){pattern}")
    squeeze = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    own = (squeeze(low) == squeeze(src)) | ((F.length(src) > 4) & F.contains(low, src))
    return F.coalesce(bad | low.isin(ORGANISATIONS) | F.coalesce(own, F.lit(False)) | ~F.length(t).between(3, 60), F.lit(True))


def clean_author(text: Column) -> Column:
    """An extracted name without prefix, date and e-mail; title case if all lower; null outside 3 to 60 characters."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    for pattern in (r"(?iu)^(par|by|auteur|author|автор)[\s:.\-]*", r"(?iu)\s+(le|on)\s+\d.*$", r"\s+\d{4}-\d{2}-\d{2}.*$", r"\s*\S+@\S+\s*$"):
        t = F.regexp_replace(t, pattern, "")
    t = F.when(t == F.lower(t), F.initcap(t)).otherwise(t)
    return F.when(F.length(t).between(3, 60), t)


# Parts of a path and endings that no article has.
_EXCLUDED = r"(?i)/(tag|tags|author|page|wp-content|wp-json|wp-admin|wp-includes|feed|comments|search|login|register|contact|about|mentions|privacy|cookies|rss|atom|sitemap|cdn-cgi)(/|$|\?)|\.(jpg|jpeg|png|gif|svg|webp|pdf|zip|mp4|mp3|css|js)(\?|$)|#"


def article_url(url: Column, host: str | Column) -> Column:
    """Whether an address looks like an article of the host: a long or dashed slug, a numeric id, or a date in its path."""
    own = F.lit(host) if isinstance(host, str) else host
    netloc = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    raw = F.regexp_extract(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"^[^?#]*", 0)
    path = F.regexp_replace(raw, "^/+|/+$", "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    last = F.element_at(F.split(path, "/"), -1)
    dashes = F.length(last) - F.length(F.replace(last, F.lit("-"), F.lit("")))
    slug = (F.length(last) >= 20) | (dashes >= 2)
    dated = path.rlike(r"/\d{4}/\d{2}/\d{2}(/|$)")
    section = F.get(parts, F.lit(0)).isin("category", "cat", "rubrique", "rubriques")
    deep = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) > 6
    ok = ((netloc == "") | (netloc == own)) & (path != "") & ~raw.rlike(_EXCLUDED) & ~deep
    return F.coalesce(ok & (~F.coalesce(section, F.lit(False)) | slug) & (slug | last.rlike(r"^\d{5,}$") | dated), F.lit(False))


# Russian months, genitive and by their first letters.
MONTHS = {"января": 1, "февраля": 2, "марта": 3, "апреля": 4, "мая": 5, "июня": 6, "июля": 7, "августа": 8, "сентября": 9, "октября": 10, "ноября": 11, "декабря": 12}
SHORT_MONTHS = {"янв": 1, "фев": 2, "мар": 3, "апр": 4, "мая": 5, "май": 5, "июн": 6, "июл": 7, "авг": 8, "сен": 9, "окт": 10, "ноя": 11, "дек": 12}


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _made(y: Column, m: Column, d: Column, low: int = 2000, high: int = 2030) -> Column:
    """A midnight; null where there is no such day or the year is implausible."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.between(low, high) & m.between(1, 12) & d.between(1, 31), text.try_cast("timestamp"))


def _part(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i).try_cast("int")


def iso_time(text: Column) -> Column:
    """ISO or RFC 822 time, fractions and offsets dropped without converting; else any date within."""
    t = F.regexp_replace(F.trim(text), r"\.\d+", "")
    plain = F.regexp_replace(t, r"(Z|[+-]\d{2}:?\d{2})$", "")
    rfc = F.trim(F.regexp_replace(F.regexp_replace(t, r"\s*[+-]\d{4}$", ""), r"^[A-Za-z]{3},\s*", ""))
    formats = [(plain, "yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), (plain, "yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), (plain, "yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), (rfc, "d MMM yyyy HH:mm:ss", r"^\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}$")]
    tried = [F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(fmt))) for s, fmt, shape in formats]
    within = F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1).try_cast("timestamp")
    return F.coalesce(*tried, within)


def url_date(url: Column) -> Column:
    p = r"/(\d{4})/(\d{1,2})/(\d{1,2})/"
    return _made(_part(url, p, 1), _part(url, p, 2), _part(url, p, 3))


def text_date(text: Column) -> Column:
    """A date in running text: day, genitive month, year; else numbers with the day first."""
    p = "(?iu)(\\d{1,2})\\s+(" + "|".join(MONTHS) + ")\\s+(\\d{4})"
    named = _made(_part(text, p, 3), _lookup(MONTHS, F.lower(F.regexp_extract(text, p, 2))), _part(text, p, 1))
    n = r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})"
    return F.coalesce(named, _made(_part(text, n, 3), _part(text, n, 2), _part(text, n, 1)))


def title_date(title: Column) -> Column:
    """dd.mm.yyyy in a programme's title."""
    p = r"(\d{2})\.(\d{2})\.(\d{4})"
    return _made(_part(title, p, 3), _part(title, p, 2), _part(title, p, 1), 1900, 2100)


def upload_date(day: Column) -> Column:
    return F.when(day.rlike(r"^\d{8}$"), F.try_to_timestamp(day, F.lit("yyyyMMdd")))


def relative_date(text: Column, now: Column) -> Column:
    """A feed's relative time mark as a time, seen at `now`; a day without year that lies over a day ahead is last year's."""
    t = F.regexp_replace(F.lower(F.trim(text)), " ", " ")
    ago = r"^(\d+)\s*(сек|мин|час|дн|ден|дня)"
    unit = F.regexp_extract(t, ago, 2)
    size = F.when(unit == "сек", 1).when(unit == "мин", 60).when(unit == "час", 3600).otherwise(86400)
    day = r"^(сегодня|вчера)(?:\s+в\s+(\d{1,2}):(\d{2}))?"
    midnight = F.date_trunc("day", now)
    clock = lambda p, h, m: F.coalesce(_part(t, p, h), F.lit(0)) * 3600 + F.coalesce(_part(t, p, m), F.lit(0)) * 60
    plus = lambda ts, seconds: F.timestamp_seconds(F.unix_timestamp(ts) + seconds)
    on = r"^(\d{1,2})\s+([а-я]{3})[а-я]*\.?\s*(?:в\s+(\d{1,2}):(\d{2})|(\d{4}))?"
    month, year = _lookup(SHORT_MONTHS, F.regexp_extract(t, on, 2)), _part(t, on, 5)
    this = plus(_made(F.year(now), month, _part(t, on, 1), 1, 9999), clock(on, 3, 4))
    last = plus(_made(F.year(now) - 1, month, _part(t, on, 1), 1, 9999), clock(on, 3, 4))
    return (
        F.when(t.startswith("только что"), now)
        .when(t.rlike(ago), plus(now, -_part(t, ago, 1) * size))
        .when(t.rlike(day), plus(midnight, F.when(F.regexp_extract(t, day, 1) == "вчера", -86400).otherwise(0) + clock(day, 2, 3)))
        .when(year.isNotNull(), _made(year, month, _part(t, on, 1), 1, 9999))
        .when(t.rlike(on), F.when(this > plus(now, F.lit(86400)), last).otherwise(this))
    )
