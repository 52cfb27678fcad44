from datetime import datetime

from pyspark.sql import functions as F

from pressloom.functions import html
from pressloom.functions.blocks import body_text
from pressloom.operators import maintenance

PAGE = """<html><head><meta name="author" content="@outlet"><script type="application/ld+json">{"@graph": [{"@type": "NewsArticle", "datePublished": "2024-03-05T10:00:00Z", "author": [{"@type": "Organization", "name": "Outlet"}, {"@type": "Person", "name": "Jane Doe"}]}]}</script></head>
<body><nav><p>menu</p><a href="/about">About</a></nav><article><h1>Head</h1><p>First <b>para</b>.<p>Second &amp; last.</article>
<a href="/news/a-long-slug-of-words?x=1#top">  Story  </a><a href="/news/a-long-slug-of-words?x=1" title="again"></a><a href="https://other.org/b-long-slug-of-words">Off</a><a href="/n/2024/03/05/x" aria-label="Dated"></a></body>"""


def one(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], list(cells)).select(column.alias("x")).first()["x"]


def test_page(spark):
    assert one(spark, html.main_text(F.col("html")), html=PAGE) == "Head\nFirst para.\nSecond & last."
    assert one(spark, html.page_author(F.col("html"), F.lit("Outlet")), html=PAGE) == "Jane Doe"
    d = one(spark, html.page_date(F.col("html"), F.col("url")), html=PAGE, url="")
    assert (d["dt"], d["method"]) == (datetime(2024, 3, 5, 10), "jsonld")


def test_cascades(spark):
    assert one(spark, html.page_author(F.col("html"), F.lit("S")), html='<span class="byline">by  jane doe</span>') == "Jane Doe"
    assert one(spark, html.page_author(F.col("html"), F.lit("S")), html="<p>nothing</p>") is None
    date = lambda h, u="": one(spark, html.page_date(F.col("html"), F.col("url")), html=h, url=u)
    assert date('<meta property="article:published_time" content="2024-03-05">')["method"] == "meta"
    assert date('<time datetime="2024-03-05T01:02:03">x</time>')["method"] == "time"
    assert date("<p>Опубликовано 8 июня 2024</p>")["dt"] == datetime(2024, 6, 8)
    assert date("<p>x</p>", "https://x.org/2024/03/05/a")["method"] == "url"
    assert date("<p>x</p>") is None


def test_links(spark):
    pages = spark.createDataFrame([(1, "https://example.org/", PAGE)], "page_id int, url string, html string")
    rows = html.article_links(pages).orderBy("pos").collect()
    assert [(r["url"], r["title"]) for r in rows] == [("https://example.org/news/a-long-slug-of-words?x=1", "Story"), ("https://example.org/n/2024/03/05/x", "Dated")]


def test_posts(spark):
    page = "".join(f'<div class="tg message_text js">{t}</div>' for t in ("a" * 90, "a" * 80 + "b" * 30, "short", "c" * 60))
    got = html.channel_posts(spark.createDataFrame([("s", page)], "source_name string, html string")).orderBy("ordinal").collect()
    assert [len(r["text"]) for r in got] == [110, 60]


def test_broken_pages(spark):
    for h in (None, "", "<", "<p><div></p></b>", "<script>if (a < b) {</script><p>x"):
        one(spark, html.main_text(F.col("html")), html=h or "")


def test_author_bylines_and_signatures(spark):
    author = lambda h, source="S": one(spark, html.page_author(F.col("html"), F.col("source")), html=h, source=source)
    assert author("<p>By Jane Doe</p>") == "Jane Doe"
    assert author("<p>Par<b>Jean Dupont</b></p><p>Text.</p>") == "Jean Dupont"
    assert author("<p>" + "x " * 200 + "by Long Paragraph</p>") is None
    assert author("".join(f"<p>by Outlet {x}</p>" for x in ("One", "Two", "Three")) + "<p>by Jane Doe</p>", "Outlet") == "Jane Doe"
    signed = '<meta name="author" content="Wire Desk"><p>Text of it.</p><p>Roger MOUSSAVOU/AGP</p>'
    assert author(signed) == "Wire Desk"
    assert author(signed, "AGP Gabon") == "Roger MOUSSAVOU"
    assert author("<p>Text of it.</p><p>Roger MOUSSAVOU / AGP</p>") == "Roger MOUSSAVOU"


def test_signature_ends_with_its_block(spark):
    """Capital words without a stop that end the block before belong to no name; inline elements and line breaks of the source don't end one."""
    pages = [
        "<article><p>It was Hend Hend</p><p>Roger MOUSSAVOU / AGP</p></article>", "<p>Theaan<br>Roger MOUSSAVOU/AGP", "<p><b>The<br/>\n<p>Roger MOUSSAVOU / AGP</p>", "<blockquote>Said Einte</blockquote>Roger MOUSSAVOU / AGP",
        "<p>Text. <b>Roger</b>\n<i>MOUSSAVOU</i> / <span>AGP</span></p>", "<p>Roger\n  MOUSSAVOU / AGP</p>", "<div>Roger MOUSSAVOU</div><div>/ AGP</div>", "<p>Text. Roger MOUSSAVOU / AGP</p><p>" + "x" * 1481 + "</p>",
    ]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = rows.select("i", html.page_author(F.col("html"), F.lit("AGP Gabon")).alias("author")).orderBy("i").collect()
    assert [r.author for r in got] == ["Roger MOUSSAVOU"] * len(pages)


def test_paragraphs_with_unclosed_bold(spark):
    page = "<article><p><b>First.<br><p>Second.</p><p>Third.</article><p><span><div>Block</div>"
    assert one(spark, html.main_text(F.col("html")), html=page) == "First.\nSecond.\nThird."


def test_table_functions_in_sql(spark):
    from pressloom.functions import tables

    tables.register(spark)
    pages = spark.createDataFrame([(1, "https://x.org/", '<a href="/a">A</a><p>one</p><a href="b#c" title="B"></a><p>two</p>'), (2, "https://x.org/", None), (3, None, "<p></p>")], "page_id int, url string, html string")
    got = spark.sql("SELECT p.page_id, l.* FROM {pages} p, LATERAL page_links(p.html, p.url) l", pages=pages).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "https://x.org/a", "A"), (1, 1, "https://x.org/b", "B")]
    lines = spark.sql("SELECT p.page_id, l.* FROM {pages} p, LATERAL page_lines(p.html) l", pages=pages).collect()
    assert sorted(map(tuple, lines), key=repr) == [(1, 0, "one"), (1, 1, "two")]


LONG = "The council met on Monday to speak about the bridge, which has been closed since the flood of last spring."


def test_main_text_by_density():
    links = "".join(f'<li><a href="/{i}">Another story of the day {i}</a></li>' for i in range(6))
    menu = f"<div><ul>{links}</ul></div>"
    bare = f"<body>{menu}<div><h2>Bridge closed</h2>{LONG}<br><br>{LONG} Again.<br>Short one.<div>{LONG} Last.</div></div>{menu}<div>Contact us</div>"
    assert body_text(bare) == "\n".join(["Bridge closed", LONG, LONG + " Again.", "Short one.", LONG + " Last."])
    comments = f'<article><h1>Bridge</h1><p>{LONG}</p><p>Short.</p></article><section class="comments-area"><h3>Two comments</h3><p>{LONG}</p></section><div id="disqus_thread"><p>{LONG}</p></div>'
    assert body_text(comments) == f"Bridge\n{LONG}\nShort."
    related = f"<main><p>{LONG}</p><h3>Related</h3>{menu}<table><tr><td>{LONG}</td></tr></table></main>"
    assert body_text(related) == LONG
    inside = f'<article><p>{LONG}</p><p><a href="/x">Read also this other story of ours</a></p><p>{LONG} With <a href="/y">one link</a> in it.</p></article>'
    assert body_text(inside) == f"{LONG}\n{LONG} With one link in it."
    assert body_text(f"<h1>Bridge</h1>{menu}<p>{LONG}</p>") == f"Bridge\n{LONG}"
    assert body_text(f"<h1>Other</h1><p>Far.</p>{menu}<p>{LONG}</p>") == LONG
    assert body_text(f'<body class="has-sidebar menu"><p>{LONG}</p></body>') == LONG
    assert body_text(menu) is None
    for h in (None, "", "<", "<div><p", "plain", "</p></div>", "<a>" * 300):
        body_text(h)


def test_main_text_of_a_long_page():
    text = body_text("<div>" * 200 + f"<p>{LONG}</p>" * 20000)
    assert text.count("\n") == 19999


def test_author_audit(spark):
    page = '<span class="byline">Jane Doe</span>'
    stored = spark.createDataFrame([(1, "Lena Kowal", "s", 1), (2, "@x", "s", 1), (3, "@x", None, 1), (4, None, "s", 1), (5, " ", "s", 1), (None, None, "s", 1), (2, "@x", "s", 1)], "id int, author string, source_name string, found int")
    pages = spark.createDataFrame([(1, page), (2, page), (2, page), (3, "<p>none</p>"), (4, page), (9, page), (None, page)], "id int, html string")
    got = maintenance.audited_authors(stored, pages)
    assert got.columns == [*stored.columns, "outcome"]
    rows = sorted(((r["id"], r["author"], r["outcome"]) for r in got.collect()), key=repr)
    assert rows == sorted([(1, "Lena Kowal", "kept"), (2, "Jane Doe", "replaced"), (2, "Jane Doe", "replaced"), (3, None, "nulled"), (4, "Jane Doe", "found"), (5, None, "missing"), (None, None, "missing")], key=repr)
    assert maintenance.audited_authors(stored.limit(0), pages.limit(0)).count() == 0
