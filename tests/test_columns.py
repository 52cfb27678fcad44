from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pressloom.functions import columns as c


def values(spark, column, rows, ddl):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


HOST = "example.org"


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://other.org/a-long-slug-of-words-here", False), ("https://example.org/", False), ("https://example.org/tag/a-b-c-d-e-f-g-h", False), ("https://example.org/a/photo-of-a-day.jpg", False), ("https://example.org/1/2/3/4/5/6/7/8-a-b-c", False),
        ("https://example.org/category/x", False), ("https://example.org/category/a-b-c", True), ("https://example.org/n/12345", True), ("https://example.org/n/1234", False), ("https://example.org/x/2024/01/02/y", True), ("https://example.org/short", False), ("https://example.org/abcdefghijklmnopqrstu", True),
    ],
)
def test_article_url(spark, url, want):
    assert values(spark, c.article_url(F.col("u"), HOST), [(url,)], "u string") == [want]


def test_dates(spark):
    ts = lambda *a: datetime(*a)
    texts = ["2024-03-05T10:20:30Z", "2024-03-05T10:20:30+03:00", "2024-03-05T10:20:30.123", "Tue, 05 Mar 2024 10:20:30 +0300", "2024-03-05", "on 2024-03-05, late", "2024-13-45", "never", None]
    got = values(spark, c.iso_time(F.col("t")), [(t,) for t in texts], "t string")
    assert got == [ts(2024, 3, 5, 10, 20, 30)] * 4 + [ts(2024, 3, 5)] * 2 + [None] * 3
    assert values(spark, c.url_date(F.col("t")), [("/1999/01/02/",), ("/2031/01/02/",), ("/2024/1/2/x",), ("/2024/02/31/",)], "t string") == [None, None, ts(2024, 1, 2), None]
    assert values(spark, c.text_date(F.col("t")), [("8 Июня 2026 г.",), ("le 08.06.2026",), ("45.06.2026",)], "t string") == [ts(2026, 6, 8), ts(2026, 6, 8), None]


def test_relative_dates(spark):
    now = "2024-02-01 12:00:00"
    texts = ["только что", "5 мин назад", "2 час назад", "3 дня назад", "сегодня в 9:15", "вчера в 23:05", "вчера", "14 авг в 10:00", "3 мая 2025", "31 янв", "soon", ""]
    got = values(spark, c.relative_date(F.col("t"), F.lit(now).cast("timestamp")), [(t,) for t in texts], "t string")
    want = [(2024, 2, 1, 12), (2024, 2, 1, 11, 55), (2024, 2, 1, 10), (2024, 1, 29, 12), (2024, 2, 1, 9, 15), (2024, 1, 31, 23, 5), (2024, 1, 31), (2023, 8, 14, 10), (2025, 5, 3), (2024, 1, 31)]
    assert got == [datetime(*w) for w in want] + [None, None]


def test_authors(spark):
    rows = [("@handle", "S"), ("La rédaction", "S"), ("Acme Ltd.", "S"), ("Example News", "Example News"), ("Team of Daily Bugle", "Daily Bugle"), ("Al", "S"), ("x" * 61, "S"), (None, "S"), ("Jane Doe", "S"), ("Jane Doe", None)]
    assert values(spark, c.bad_author(F.col("a"), F.col("s")), rows, "a string, s string") == [True] * 8 + [False] * 2
    texts = [("by Jane Doe",), ("автор: Иван Петров",), ("jane doe",), ("Jane Doe le 3 mai",), ("Jane Doe jane@doe.org",), ("ab",)]
    assert values(spark, c.clean_author(F.col("a")), texts, "a string") == ["Jane Doe", "Иван Петров", "Jane Doe", "Jane Doe", "Jane Doe", None]


def test_scalars(spark):
    rows = [("youtube", "https://x.org/watch?v=a_B-1&t=90s", "r"), ("tv", "https://x.org/video/ab12/?t=5", "r"), ("press", "https://x.org/v=1", "r")]
    assert values(spark, c.parent_id(F.col("k"), F.col("u"), F.col("i")), rows, "k string, u string, i string") == ["a_B-1", "ab12", "r"]
    assert values(spark, c.offset_seconds(F.col("u")), rows, "k string, u string, i string") == [90, 5, None]
    assert values(spark, c.clamp(F.col("t"), -1.0, 1.0), [("3",), ("-7",), ("x",), (None,), ("0.5",)], "t string") == [1.0, -1.0, 0.0, 0.0, 0.5]
    assert values(spark, c.lenient_json(F.col("t")), [('```json\n{"a": 1}\n```',), ('Sure: {"a": {"b": 2}} ok',), ("none",)], "t string") == ['{"a": 1}', '{"a": {"b": 2}}', None]
    assert values(spark, c.fold(F.col("t")), [("Éàß Ёй ñ",)], "t string") == ["Eaß Еи n"]
    assert values(spark, c.first_line(F.col("t")), [("a\nb",), ("\nb",), ("x" * 130,)], "t string") == ["a", "\nb", "x" * 120]
