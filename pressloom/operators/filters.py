"""The reader's filter, eligibility and lexical predicates over articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.plans.search import keyword_filter


# Names by which a text concerns one of the sixteen targets. Short roots that are parts of common words stand between word boundaries.
TARGET_NAMES = [
    r"украин|зеленск|киев|всу\b|донбасс|донецк|луганск|запорож|херсон|крым",
    r"сша|американ|вашингтон|трамп|байден|пентагон",
    r"европейский союз|\bес\b|брюссел|еврокомисси",
    r"нато|североатлантич",
    r"германи|немецк|берлин|шольц|мерц",
    r"франци|французск|макрон|париж",
    r"прибалтик|эстони|латви|литв",
    r"кита[ий]|китайск|пекин|си цзиньпин",
    r"инди[яйи]|индийск|\bдели\b|\bмоди\b",
    r"западн[а-я]* стран|западн[а-я]* мир|западные партнеры",
    r"брикс|глобальный юг",
    r"грузи[яю]|грузинск|тбилиси",
    r"навальн|оппозицион|иноагент",
    r"казахстан|астана|токаев",
    r"армени[яю]|ереван|пашинян",
    r"молдав|кишинев|приднестров|санду",
    r"\bиран|тегеран|хаменеи",
    r"шахед|герань-2",
]
# Roots by which a video counts as political, by subject.
POLITICAL_STEMS = [
    "войн", "воен", "арми", "фронт", "мобилизац", "призыв", "военкомат", "оборон", "удар", "обстрел", "дрон", "бпла", "ракет", "наступлен", "сво ", "всу", "солдат", "офицер", "генерал", "оккупац", "теракт", "спецслужб", "фсб", "гру", "кгб", "вагнер", "чвк",
    "путин", "кремл", "госдум", "дум", "выбор", "депутат", "министр", "правительств", "власт", "президент", "губернатор", "чиновник", "оппозиц", "навальн", "яблок", "партия", "митинг", "протест", "лавров", "медведев", "шойгу", "мишустин", "патрушев", "кадыров",
    "репресс", "арест", "суд", "приговор", "тюрьм", "колони", "уголовн", "иноагент", "экстремис", "цензур", "полиц", "росгварди", "закон", "заключен", "обыск", "штраф", "пытк",
    "санкц", "бюджет", "инфляц", "рубл", "экономик", "нефт", "газпром", "энерг", "налог", "девальвац", "дефицит", "коррупц", "олигарх",
    "украин", "россия", "росси", "москв", "киев", "нато", "запад", "сша", "америк", "трамп", "европ", "евросоюз", "ес ", "китай", "белорус", "лукашенк", "казахстан", "армени", "грузи", "молдав", "иран", "израил", "сири", "кндр", "корея", "турци", "польш", "прибалтик", "эстони", "латви", "литв", "чечн", "крым", "донбасс", "зеленск", "переговор", "перемири", "дипломат", "посол", "саммит",
    "мигрант", "эмиграц", "релокант", "пропаганд", "цензур", "церков", "патриарх", "демограф", "мобилизован", "беженц",
]


def concerns_targets(text: Column) -> Column:
    """Whether a text names any target, and so goes to the stance scorer. Null: no."""
    return F.coalesce(text, F.lit("")).rlike("(?iU)(" + "|".join(TARGET_NAMES) + ")")


def political(*columns: str) -> Column:
    """Whether any political root is in the columns, case and ё aside."""
    return any_stem(POLITICAL_STEMS, *columns)


def article_filter(start: str | None = None, end: str | None = None, *, search: str | None = None, default: str = "AND", **lists: list[str] | None) -> Column:
    """Dates from start to the whole of end, each optional; a list for each named column (empty: all); the search box."""
    parts = [F.lit(True)]
    if start:
        parts.append(F.col("published_at") >= F.lit(start).cast("timestamp"))
    if end:
        parts.append(F.col("published_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    parts += [F.col(c).isin(list(xs)) for c, xs in lists.items() if xs]
    box = keyword_filter(search, default)
    return reduce(lambda a, b: a & b, parts if box is None else [*parts, box])


def simple_filter(source: str | None = None, text: str | None = None, start: str | None = None, end: str | None = None) -> Column:
    """The explorer's form: one source, plain text in title or content, dates."""
    out = article_filter(start, end, source_name=[source] if source else None)
    return out & (F.col("title").ilike(f"%{text}%") | F.col("content").ilike(f"%{text}%")) if text else out


def matches(term: str, column: str = "content") -> Column:
    """A curated pattern anywhere in the lower-case text."""
    return F.coalesce(F.lower(F.col(column)).rlike(term), F.lit(False))


def any_stem(stems: list[str], *columns: str) -> Column:
    """Any stem in any of the columns, case and ё aside."""
    hay = F.replace(F.lower(F.concat_ws(" ", *columns)), F.lit("ё"), F.lit("е"))
    return reduce(lambda a, b: a | b, [F.contains(hay, F.lit(s)) for s in stems])


def missing_content(floor: int = 300, source: str | None = None) -> Column:
    """Rows to fetch again: no text or too little (50 characters will do for telegram), but an address."""
    least = F.when(F.col("source_kind") == "telegram", 50).otherwise(floor)
    out = (F.col("content").isNull() | (F.length("content") < least)) & F.col("url").isNotNull()
    return out & (F.col("source_name") == source) if source else out


def video_floor(min_seconds: int = 180, max_age_days: int = 60, as_of: str = "") -> Column:
    """Videos long and recent enough."""
    return (F.col("duration") >= min_seconds) & (F.col("published_at") >= F.date_sub(F.lit(as_of).cast("date"), max_age_days).cast("timestamp"))


def source_like(df: DataFrame, name: str, most: int = 5) -> DataFrame:
    """Source names that hold the first word of what was asked for."""
    return df.filter(F.col("source_name").ilike(f"%{name.split()[0]}%")).select("source_name").distinct().orderBy("source_name").limit(most)
