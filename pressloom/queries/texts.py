"""Scalar columns, transcripts, pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressloom.functions import columns as c
from pressloom.functions import html, scoring, segments, tables
from pressloom.operators import corpus, filters, language, lemmas, lexical, maintenance, stances
from pressloom.plans.articles import PARENT, TARGETS, VIEWS, WORDS, articles, sentiment, table
from pressloom.registry import query
from pressloom.sources.landed import cues_of


@query("scl01", f"{VIEWS} SELECT id, {PARENT} AS parent FROM A")
def scl01(spark, sf_dir):
    return articles(spark, sf_dir).select("id", corpus.parent().alias("parent"))


@query("scl02", f"{VIEWS} SELECT id, TRY_CAST(regexp_extract(url, '[?&#]t=(\\d+)', 1) AS INTEGER) AS seconds FROM A")
def scl02(spark, sf_dir):
    return articles(spark, sf_dir).select("id", c.offset_seconds(F.col("url")).alias("seconds"))


@query("scl03", f"{VIEWS} SELECT id, {WORDS}::BIGINT AS mots, left(content, 250) AS extrait FROM A")
def scl03(spark, sf_dir):
    return articles(spark, sf_dir).select("id", c.word_count(F.col("content")).alias("mots"), c.excerpt(F.col("content")).alias("extrait"))


@query("scl04", f"{VIEWS} SELECT id, CASE WHEN type_media IN ('etat', 'para_etat') THEN 'aligne_etat' ELSE 'independant_exil' END AS bloc FROM A")
def scl04(spark, sf_dir):
    return articles(spark, sf_dir).select("id", c.block(F.col("type_media")).alias("bloc"))


@query("scl05", f"{VIEWS} SELECT doc_id, left(sha256(url), 16) AS h FROM A")
def scl05(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", c.url_hash(F.col("url")).alias("h"))


@query("scl06", "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def scl06(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(c.fold(F.col("text"))).alias("folded"))


_F = "'%Y-%m-%d'"


@query("scl07", f"{VIEWS} SELECT id, strftime(date_trunc('day', published_at), {_F}) AS d, strftime(date_trunc('week', published_at), {_F}) AS w, strftime(date_trunc('month', published_at), {_F}) AS m FROM A")
def scl07(spark, sf_dir):
    p = F.col("published_at")
    return articles(spark, sf_dir).select("id", *[F.date_format(c.period(p, g), "yyyy-MM-dd").alias(g[0]) for g in ("day", "week", "month")])


@query("scl08", f"{VIEWS} SELECT source_name, count(*) FILTER (CAST(published_at AS DATE) >= DATE '2024-01-31' - INTERVAL 7 DAY)::BIGINT AS n FROM A GROUP BY 1")
def scl08(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("source_name").agg(F.count_if(F.to_date("published_at") >= F.date_sub(F.lit("2024-01-31").cast("date"), 7)).alias("n"))


@query("scl10", f"{VIEWS} SELECT id, regexp_replace(title, ' \\[\\d+/\\d+\\]$', '') AS titre FROM A")
def scl10(spark, sf_dir):
    return articles(spark, sf_dir).select("id", c.strip_part(F.col("title")).alias("titre"))


@query("scl12", f"{VIEWS} SELECT id, CASE WHEN length(left(trim(split_part(content, chr(10), 1)), 120)) > 0 THEN left(trim(split_part(content, chr(10), 1)), 120) ELSE left(content, 120) END AS titre FROM A")
def scl12(spark, sf_dir):
    return articles(spark, sf_dir).select("id", c.first_line(F.col("content")).alias("titre"))


@query("scl13", "SELECT event_id, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, coalesce(value / 50 - 1, 0)))::DOUBLE AS lean FROM events")
def scl13(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", c.clamp(F.col("value") / 50 - 1, -1.0, 1.0).alias("lean"))


@query("scl14", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scl14(spark, sf_dir):
    """JSON in replies wrapped in fences and talk."""
    reply = F.concat(F.lit("Here you are:\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(c.lenient_json(reply), "$.k").try_cast("long").alias("k"))


@query("scl15", f"{VIEWS} SELECT id, strftime(date_trunc('second', published_at), '%Y-%m-%d %H:%M:%S') AS dt FROM A")
def scl15(spark, sf_dir):
    """Times written in three formats and read back."""
    p = F.col("published_at")
    text = F.when(F.col("doc_id") % 3 == 0, F.date_format(p, "yyyy-MM-dd'T'HH:mm:ss'.123+03:00'")).when(F.col("doc_id") % 3 == 1, F.date_format(p, "EEE, dd MMM yyyy HH:mm:ss +0300")).otherwise(F.date_format(p, "yyyy-MM-dd HH:mm:ss"))
    return articles(spark, sf_dir).select("id", F.date_format(c.iso_time(text), "yyyy-MM-dd HH:mm:ss").alias("dt"))


_MONTH = "['" + "', '".join(c.MONTHS) + "']"


@query("scl16", f"{VIEWS} SELECT id, strftime(CAST(published_at AS DATE), {_F}) AS dt FROM A")
def scl16(spark, sf_dir):
    """Dates in words or figures within text, read back."""
    p = F.col("published_at")
    name = F.element_at(F.array(*[F.lit(m) for m in c.MONTHS]), F.month(p))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Опубликовано "), F.day(p).cast("string"), F.lit(" "), name, F.lit(" "), F.year(p).cast("string"))).otherwise(F.date_format(p, "'le' dd.MM.yyyy"))
    return articles(spark, sf_dir).select("id", F.date_format(c.text_date(text), "yyyy-MM-dd").alias("dt"))


@query("scl17", f"{VIEWS} SELECT id, strftime(CAST(published_at AS DATE), {_F}) AS dt FROM A")
def scl17(spark, sf_dir):
    url = F.date_format("published_at", "'https://example.org/'yyyy/MM/dd'/news'")
    return articles(spark, sf_dir).select("id", F.date_format(c.url_date(url), "yyyy-MM-dd").alias("dt"))


@query("scl18", f"{VIEWS} SELECT id, strftime(TIMESTAMP '2024-02-01 12:00:00' - to_minutes(doc_id % 59 + 1), '%Y-%m-%d %H:%M') AS dt FROM A")
def scl18(spark, sf_dir):
    text = F.concat((F.col("doc_id") % 59 + 1).cast("string"), F.lit(" мин назад"))
    return articles(spark, sf_dir).select("id", F.date_format(c.relative_date(text, F.lit("2024-02-01 12:00:00").cast("timestamp")), "yyyy-MM-dd HH:mm").alias("dt"))


@query("scl19", f"{VIEWS} SELECT id, strftime(CAST(published_at AS DATE), {_F}) AS dt FROM A")
def scl19(spark, sf_dir):
    title = F.date_format("published_at", "'Programme' dd.MM.yyyy")
    return articles(spark, sf_dir).select("id", F.date_format(c.title_date(title), "yyyy-MM-dd").alias("dt"))


@query("scl22", f"{VIEWS} SELECT DISTINCT strftime(date_trunc('week', published_at), {_F}) AS monday, strftime(date_trunc('week', published_at) + INTERVAL 6 DAY, {_F}) AS sunday FROM A WHERE published_at IS NOT NULL")
def scl22(spark, sf_dir):
    m = c.week_of(F.col("published_at"))
    return articles(spark, sf_dir).filter("published_at IS NOT NULL").select(F.date_format(m, "yyyy-MM-dd").alias("monday"), F.date_format(F.date_add(m, 6), "yyyy-MM-dd").alias("sunday")).distinct()


@query("scl23", f"{VIEWS} SELECT id, strftime(CAST(published_at AS DATE), {_F}) AS dt FROM A")
def scl23(spark, sf_dir):
    return articles(spark, sf_dir).select("id", F.date_format(c.upload_date(F.date_format("published_at", "yyyyMMdd")), "yyyy-MM-dd").alias("dt"))


_RAW_AUTHOR = "CASE doc_id % 6 WHEN 0 THEN 'by  ' || author WHEN 1 THEN author || ' le 3 mai' WHEN 2 THEN '@handle' WHEN 3 THEN 'Press Group Ltd' WHEN 4 THEN source_name || ' desk' ELSE author END"


@query("flt08", f"{VIEWS}, r AS (SELECT id, {_RAW_AUTHOR} AS raw FROM A) SELECT id, CASE WHEN raw IS NULL OR raw IN ('@handle', 'Press Group Ltd') THEN true WHEN length(raw) NOT BETWEEN 3 AND 60 THEN true WHEN raw LIKE 'src%' AND length(split_part(raw, ' ', 1)) > 4 THEN true ELSE false END AS bad FROM r")
def flt08(spark, sf_dir):
    return articles(spark, sf_dir).withColumn("raw", F.expr(_RAW_AUTHOR)).select("id", c.bad_author(F.col("raw"), F.col("source_name")).alias("bad"))


@query("scl21", f"{VIEWS}, r AS (SELECT id, doc_id, source_name, author FROM A) SELECT id, CASE doc_id % 6 WHEN 0 THEN author WHEN 2 THEN '@handle' WHEN 3 THEN 'Press Group Ltd' WHEN 4 THEN 'Src' || substr(source_name, 4) || ' Desk' END AS name FROM r")
def scl21(spark, sf_dir):
    return articles(spark, sf_dir).withColumn("raw", F.expr(_RAW_AUTHOR)).select("id", c.clean_author(F.col("raw")).alias("name"))


_ARTICLE = "path <> '' AND NOT regexp_matches('/' || path, '(?i)/(tag|tags|author|page|wp-content|wp-json|wp-admin|wp-includes|feed|comments|search|login|register|contact|about|mentions|privacy|cookies|rss|atom|sitemap|cdn-cgi)(/|$)|\\.(jpg|jpeg|png|gif|svg|webp|pdf|zip|mp4|mp3|css|js)$') AND length(path) - length(replace(path, '/', '')) <= 6 AND (length(last) >= 20 OR length(last) - length(replace(last, '-', '')) >= 2 OR regexp_matches(last, '^\\d{5,}$') OR regexp_matches(path, '/\\d{4}/\\d{2}/\\d{2}(/|$)')) AND (NOT string_split(path, '/')[1] IN ('category', 'cat', 'rubrique', 'rubriques') OR length(last) >= 20 OR length(last) - length(replace(last, '-', '')) >= 2)"


@query("src04", "WITH u AS (SELECT page_id, regexp_replace(url, '/+$', '') AS url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages), p AS (SELECT page_id, url, trim(regexp_extract(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '^[^?#]*'), '/') AS path FROM u), l AS (SELECT *, string_split(path, '/')[-1] AS last FROM p) SELECT page_id, " + _ARTICLE + " AS article FROM l")
def src04(spark, sf_dir):
    url = F.regexp_replace("url", "/+$", "")
    return table(spark, sf_dir, "pages").select("page_id", c.article_url(url, F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)).alias("article"))


@query("src06", f"{VIEWS}, r AS (SELECT id, row_number() OVER (PARTITION BY source_name, left(content, 80) ORDER BY length(content) DESC, doc_id) AS r FROM A WHERE content IS NOT NULL) SELECT id FROM r WHERE r = 1")
def src06(spark, sf_dir):
    posts = articles(spark, sf_dir).filter("content IS NOT NULL").select("id", "source_name", F.col("content").alias("text"), F.col("doc_id").alias("ordinal"))
    return html.longest_by_prefix(posts).select("id")


@query("src08", "WITH t AS (SELECT conv_id, turn, trim(replace(text, chr(10), ' ')) AS text FROM conversations), f AS (SELECT * FROM t WHERE length(text) > 0), l AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM f) SELECT conv_id, turn FROM l WHERE before IS NULL OR before <> text")
def src08(spark, sf_dir):
    return segments.clean_cues(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn")


@query("src02", """WITH l AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) SELECT DISTINCT page_id, rtrim(base || split_part(href, '#', 1), '/') AS url FROM l""")
def src02(spark, sf_dir):
    """Links on landed pages."""
    return html.links(table(spark, sf_dir, "pages")).select("page_id", "url")


_PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


_LINKS = f"""WITH f AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS found FROM pages), a AS (SELECT page_id, base, unnest(found) AS a, unnest(range(len(found))) AS pos FROM f),
 t AS (SELECT page_id, pos, base, trim(split_part({_PLAIN.format("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")}, '#', 1), '/') AS path, {_PLAIN.format("regexp_extract(a, '>([^<]*)<', 1)")} AS title FROM a),
 r AS (SELECT *, rtrim(base || '/' || path, '/') AS url, string_split(path, '/')[-1] AS last, row_number() OVER (PARTITION BY page_id, base, path ORDER BY pos) AS r FROM t) SELECT page_id, pos::INTEGER AS pos, url, left(trim(title), 300) AS title, {_ARTICLE} AS article FROM r WHERE r = 1"""


@query("src03", _LINKS)
def src03(spark, sf_dir):
    """The same with place, title and whether they look like articles."""
    return html.links(table(spark, sf_dir, "pages"))


@query("src03_lateral", _LINKS)
def src03_lateral(spark, sf_dir):
    """The same links by the table function, called from SQL."""
    tables.register(spark)
    sql = "SELECT p.page_id, regexp_extract(p.url, '^[a-z]+://([^/?#]*)', 1) AS host, l.* FROM {pages} p, LATERAL page_links(p.html, p.url) l"
    return html.first_links(spark.sql(sql, pages=table(spark, sf_dir, "pages")))


_ARTICLE_TEXT = f"""WITH a AS (SELECT page_id, string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(p|h1)>') AS parts FROM pages), p AS (SELECT page_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM a),
 t AS (SELECT page_id, i, trim(regexp_replace({_PLAIN.format("regexp_replace(part, '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g')) AS line FROM p), j AS (SELECT page_id, string_agg(line, chr(10) ORDER BY i) FILTER (line <> '') AS text FROM t GROUP BY 1) SELECT page_id, length(text)::INTEGER AS n, md5(text) AS digest FROM j"""


@query("src14", _ARTICLE_TEXT)
def src14(spark, sf_dir):
    """Main text of landed pages: its length and digest."""
    text = html.main_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text")).select("page_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query("src14_density", _ARTICLE_TEXT)
def src14_density(spark, sf_dir):
    """The same with menus, links, comments and scraps planted around and inside the articles, which lose their element: none of it may count."""
    menu = "<div>" + "".join(f'<div><a href="/r{i}">Section number {i} of the site</a></div>' for i in range(8)) + "</div>"
    inside = '<div><a href="/more">Read also what was written about it before</a></div><div class="share-buttons">Share this text with all of your friends and with everybody else you know, today and tomorrow</div>'
    behind = '<div><span>12 replies</span></div><div id="comments">' + "<p>A reader says at some length what readers say, and that there would be much more to say about it.</p>" * 3 + "</div>" + menu + "<div>All rights reserved</div>"
    h = F.replace("html", F.lit("<article>"), F.lit(menu + '<div class="text">'))
    h = F.replace(F.replace(h, F.lit("</h1>"), F.lit("</h1>" + inside)), F.lit("</article>"), F.lit("</div>" + behind))
    return table(spark, sf_dir, "pages").select("page_id", html.main_text(h).alias("text")).select("page_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


_WORDS = "unnest(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]+', ' ', 'g')), ' '))"
_GRAMS = "unnest(list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i, 3))) AS gram"


def _language_sql(texts, learned="true"):
    """texts: SQL of key, text; learned: which documents profiles are learned from."""
    return f"""WITH tw AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, {_WORDS} AS word FROM documents WHERE lang IS NOT NULL AND {learned}) WHERE word <> '' GROUP BY ALL),
 by_l AS (SELECT lang, gram, sum(n) AS n FROM (SELECT lang, n, {_GRAMS} FROM tw) GROUP BY ALL), tot AS (SELECT lang, sum(n) AS total, (SELECT count(DISTINCT gram) FROM by_l) AS grams FROM by_l GROUP BY 1),
 xw AS (SELECT key, word, count(*) AS n FROM (SELECT key, {_WORDS} AS word FROM ({texts})) WHERE word <> '' GROUP BY ALL), c AS (SELECT key, gram, sum(n) AS n FROM (SELECT key, n, {_GRAMS} FROM xw) GROUP BY ALL), size AS (SELECT key, sum(n) AS size FROM c GROUP BY 1),
 sc AS (SELECT key, lang, sum(c.n * ln((coalesce(by_l.n, 0) + 0.5) / (total + 0.5 * (grams + 1)))) AS s FROM c CROSS JOIN tot LEFT JOIN by_l USING (lang, gram) GROUP BY ALL),
 f AS (SELECT key, lang, round(s / size, 9) AS score FROM sc JOIN size USING (key)), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, lang) AS r FROM f)
 SELECT key, lang AS language, round(score, 6) AS score FROM r WHERE r = 1"""


@query("src14_language", _language_sql("SELECT doc_id AS key, text FROM documents", "doc_id % 5 <> 0"))
def src14_language(spark, sf_dir):
    """Every document's language, by profiles learned from four fifths of them; the rest show how well."""
    docs = table(spark, sf_dir, "documents")
    return language.identified(docs.select(F.col("doc_id").alias("key"), "text"), language.profiles(docs.filter("doc_id % 5 <> 0")), "key").withColumn("score", F.round("score", 6))


@query("src14_pages", _language_sql("SELECT page_id AS key, string_agg(line, chr(10) ORDER BY i) FILTER (line <> '') AS text FROM (SELECT page_id, i, trim(regexp_replace(" + _PLAIN.format("regexp_replace(part, '<[^>]*>', '', 'g')") + ", '\\s+', ' ', 'g')) AS line FROM (SELECT page_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM (SELECT page_id, string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(p|h1)>') AS parts FROM pages))) GROUP BY 1"))
def src14_pages(spark, sf_dir):
    """The language of every landed page's main text."""
    text = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), html.main_text(F.col("html")).alias("text"))
    return language.identified(text, language.profiles(table(spark, sf_dir, "documents")), "key").withColumn("score", F.round("score", 6))


@query("txt03_lemmas", f"""{VIEWS}, tk AS (SELECT replace(unnest(regexp_extract_all(lower(content), '[a-zA-Zа-яёА-ЯЁ][a-zA-Zа-яёА-ЯЁ\\-'']{{2,}}')), 'ё', 'е') AS word FROM A),
 ct AS (SELECT word, count(*) AS n FROM tk GROUP BY 1), kn AS (SELECT word, left(word, length(word) - 1) AS lemma FROM ct WHERE word LIKE '%s' AND left(word, length(word) - 1) IN (SELECT word FROM ct) UNION ALL SELECT word, word FROM ct WHERE word NOT LIKE '%s' AND n > 1),
 sh AS (SELECT word, lemma, len(list_filter(range(1, least(length(word), length(lemma)) + 1), lambda i: left(word, i) = left(lemma, i))) AS shared FROM kn),
 en AS (SELECT word, lemma, unnest(range(greatest(shared - 4, 0), shared + 1)) AS place FROM sh), ru AS (SELECT substr(word, place + 1) AS suffix, substr(lemma, place + 1) AS ending, count(*) AS n FROM en GROUP BY ALL),
 be AS (SELECT suffix, arg_min(ending, struct_pack(m := -n, e := ending)) AS ending, max(n) AS n FROM ru GROUP BY 1 HAVING max(n) >= 2),
 su AS (SELECT word, unnest(range(0, length(word) + 1)) AS size FROM ct WHERE word NOT IN (SELECT word FROM kn)), hi AS (SELECT word, max(size) AS size, arg_max(ending, size) AS ending FROM su JOIN be ON suffix = right(word, size) GROUP BY 1),
 le AS (SELECT word, lemma FROM kn UNION ALL SELECT ct.word, CASE WHEN size IS NULL THEN ct.word ELSE left(ct.word, length(ct.word) - size) || ending END FROM ct LEFT JOIN hi USING (word) WHERE ct.word NOT IN (SELECT word FROM kn))
 SELECT lemma, sum(n)::BIGINT AS n, count(*)::BIGINT AS words FROM ct JOIN le USING (word) GROUP BY 1""")
def txt03_lemmas(spark, sf_dir):
    """Occurrences and forms by lemma. The dictionary is made of the corpus: words whose form without s occurs too, and repeated words without s; rules learned from it do the rest."""
    t = articles(spark, sf_dir).select(F.explode(lexical.tokens(F.col("content"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    bare = F.expr("left(word, length(word) - 1)")
    known = t.filter("word LIKE '%s'").select("word", bare.alias("lemma")).join(t.select(F.col("word").alias("lemma")), "lemma", "left_semi").select("word", "lemma")
    known = known.unionByName(t.filter("word NOT LIKE '%s' AND n > 1").select("word", F.col("word").alias("lemma")))
    return lemmas.lemmatise(t.withColumnRenamed("word", "token"), known).groupBy(F.col("token").alias("lemma")).agg(F.sum("n").alias("n"), F.count("*").alias("words"))


def _planted(pages, tag: str, parts: list[str]):
    """Pages with one of several parts put behind a tag, by page_id; a % in a part stands for a day."""
    day = F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    part = F.replace(F.element_at(F.array(*[F.lit(x) for x in parts]), (F.col("page_id") % len(parts) + 1).cast("int")), F.lit("%"), day)
    return pages.withColumn("html", F.replace("html", F.lit(tag), F.concat(F.lit(tag), part)))


@query("txt07", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Anna Berg' WHEN 1 THEN 'Jean Dupont' WHEN 2 THEN 'Maria Rossi' WHEN 3 THEN 'Jane Doe' ELSE 'Roger MOUSSAVOU' END AS author FROM pages")
def txt07(spark, sf_dir):
    """Authors of the pages, each of which names one in another of the cascade's five places."""
    places = [
        '<script type="application/ld+json">{"@graph": [{"author": [{"@type": "Organization", "name": "Outlet"}, {"name": "Anna Berg"}]}]}</script>', '<meta name="author" content="@handle"><meta property="article:author" content="par Jean Dupont">',
        '<span class="byline">maria rossi</span>', "<p>By Jane Doe</p>", '<meta name="author" content="Wire Desk">',
    ]
    host = F.when(F.col("page_id") % 5 == 4, "agp.example.com").otherwise(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1))
    signed = F.when(F.col("page_id") % 5 == 4, F.replace("html", F.lit("</article>"), F.lit("<p>Roger MOUSSAVOU / AGP</p></article>"))).otherwise(F.col("html"))
    return _planted(table(spark, sf_dir, "pages"), "<body>", places).select("page_id", html.page_author(signed, host).alias("author"))


@query("txt08", f"{VIEWS}, r AS (SELECT id, doc_id, source_name, author FROM A) SELECT id, CASE WHEN doc_id % 6 = 0 THEN author WHEN doc_id % 6 = 4 AND length(source_name) <= 4 THEN 'Src' || substr(source_name, 4) || ' Desk' END AS author FROM r")
def txt08(spark, sf_dir):
    """Bad authors nulled, the others cleaned, in one pass."""
    raw = F.expr(_RAW_AUTHOR)
    return articles(spark, sf_dir).select("id", F.when(~c.bad_author(raw, F.col("source_name")), c.clean_author(raw)).alias("author"))


_AUDITED = "CASE page_id % 4 WHEN 0 THEN 'Lena Kowal' WHEN 1 THEN '@handle' WHEN 2 THEN '  ' END"


@query("txt08_audit", f"""WITH r AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS source_name, {_AUDITED} AS had, CASE page_id % 3 WHEN 0 THEN 'Anna Berg' WHEN 1 THEN 'Maria Rossi' END AS held FROM pages WHERE page_id % 5 <> 0 UNION ALL SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), {_AUDITED}, NULL FROM pages WHERE page_id % 5 = 0),
 o AS (SELECT source_name, CASE WHEN had = 'Lena Kowal' THEN 'kept' WHEN had = '@handle' THEN if(held IS NULL, 'nulled', 'replaced') ELSE if(held IS NULL, 'missing', 'found') END AS outcome, CASE WHEN had = 'Lena Kowal' THEN had ELSE held END AS author FROM r)
 SELECT source_name, outcome, author, count(*)::BIGINT AS n FROM o GROUP BY ALL""")
def txt08_audit(spark, sf_dir):
    """Stored authors, a quarter good, a quarter bad and half blank, audited against pages of which a third name none (their texts have words like 'par', but not among the first 20 elements) and a fifth is gone: outcomes and authors by source."""
    pages = _planted(table(spark, sf_dir, "pages"), "<body>", ['<meta name="author" content="par Anna Berg">', '<span class="byline">maria rossi</span>', "<span>-</span>" * 20])
    stored = pages.select("page_id", F.expr(_AUDITED).alias("author"), F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("source_name"))
    rows = maintenance.audited_authors(stored, pages.filter("page_id % 5 <> 0"), "page_id")
    return rows.groupBy("source_name", "outcome", "author").agg(F.count("*").alias("n"))


_DAY = "lpad((page_id % 28 + 1)::VARCHAR, 2, '0')"
_DATED = f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN '2024-03-' || {_DAY} || ' 10:00:00' WHEN 1 THEN '2024-04-' || {_DAY} || ' 00:00:00' WHEN 2 THEN '2024-05-' || {_DAY} || ' 01:02:03' WHEN 3 THEN '2024-06-' || {_DAY} || ' 00:00:00' ELSE '2024-07-' || {_DAY} || ' 00:00:00' END AS dt, CASE page_id % 5 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'meta' WHEN 2 THEN 'time' WHEN 3 THEN 'text' ELSE 'url' END AS method FROM pages"


def _dated(spark, sf_dir):
    """The pages, each with its date in another of the cascade's five places."""
    places = ['<script type="application/ld+json">{"datePublished": "2024-03-%T10:00:00Z"}</script>', '<meta property="article:published_time" content="2024-04-%">', '<time datetime="2024-05-%T01:02:03">then</time>', "<p>Опубликовано % июня 2024</p>", "<hr>"]
    url = F.concat(F.lit("https://example.org/2024/07/"), (F.col("page_id") % 28 + 1).cast("string"), F.lit("/a"))
    return _planted(table(spark, sf_dir, "pages"), "<body>", places).withColumn("url", F.when(F.col("page_id") % 5 == 4, url).otherwise(F.col("url")))


@query("txt09", _DATED)
def txt09(spark, sf_dir):
    """Dates of the pages and the way each was found."""
    return _dated(spark, sf_dir).select("page_id", html.page_date(F.col("html"), F.col("url")).alias("d")).select("page_id", F.date_format("d.dt", "yyyy-MM-dd HH:mm:ss").alias("dt"), "d.method")


_STORED = "CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS published_at, TIMESTAMP '2024-08-01 00:00:00' AS fetched_at"


@query("str06", f"""WITH d AS ({_DATED}), s AS (SELECT page_id, {_STORED} FROM pages), r AS (SELECT page_id, CASE WHEN published_at IS NOT NULL THEN 'kept' WHEN page_id % 7 = 0 THEN 'fetched' ELSE method END AS method, coalesce(strftime(published_at, '%Y-%m-%d %H:%M:%S'), CASE WHEN page_id % 7 = 0 THEN strftime(fetched_at, '%Y-%m-%d %H:%M:%S') ELSE dt END) AS dt FROM s JOIN d USING (page_id))
 SELECT method, count(*)::BIGINT AS n, min(dt) AS first_date, max(dt) AS last_date FROM r GROUP BY 1""")
def str06(spark, sf_dir):
    """Two thirds of the stored rows without a date, repaired from the pages that could be fetched again (six of seven): counts and dates by method."""
    pages = _dated(spark, sf_dir)
    stored = pages.select("page_id", *[F.expr(x) for x in _STORED.split(", ")])
    rows = maintenance.late_dates(stored, pages.filter("page_id % 7 <> 0"), "page_id")
    rows = rows.withColumn("dt", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))
    return rows.groupBy("method").agg(F.count("*").alias("n"), F.min("dt").alias("first_date"), F.max("dt").alias("last_date"))


# SQL of segments over cues k, i, t, w: the fold as a recursion over sizes, then blocks b with a short last one joined to the one before.
_BLOCKS = """z AS MATERIALIZED (SELECT k, i, length(w) + 1 AS size, regexp_matches(w, '[.!?…][''"»)]?\\s*$') AS ends FROM cues),
 r AS (SELECT k, -1::BIGINT AS i, 0::BIGINT AS n, -1::BIGINT AS b FROM z WHERE i = 0 UNION ALL SELECT k, i, CASE WHEN m >= 2000 AND ends THEN 0 ELSE m END, b FROM (SELECT k, z.i, ends, CASE WHEN n = 0 OR n + size > 2300 THEN size ELSE n + size END AS m, CASE WHEN n = 0 OR n + size > 2300 THEN b + 1 ELSE b END AS b FROM r JOIN z USING (k) WHERE z.i = r.i + 1)),
 g AS (SELECT k, b, min(t) AS start, string_agg(w, ' ' ORDER BY i) AS text FROM cues JOIN r USING (k, i) GROUP BY 1, 2), h AS (SELECT *, CASE WHEN b > 0 AND b = max(b) OVER (PARTITION BY k) AND length(text) < 300 THEN b - 1 ELSE b END AS segment FROM g),
 segments AS (SELECT k, segment::INTEGER AS segment, min(start) AS start, string_agg(text, ' ' ORDER BY b) AS text FROM h GROUP BY 1, 2)"""


_SEGMENTED = f"""WITH RECURSIVE l AS (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(1)), chr(1)) AS ws FROM documents), cues AS MATERIALIZED (SELECT doc_id AS k, unnest(ws) AS w, unnest(range(len(ws))) AS i, (i * 4)::DOUBLE AS t FROM l), {_BLOCKS}
 SELECT k AS doc_id, segment, start, length(text)::INTEGER AS n, md5(text) AS digest FROM segments"""


@query("txt01", _SEGMENTED)
def txt01(spark, sf_dir):
    """Documents' words as cues, regrouped into segments: start, length and digest of each."""
    words = F.split("text", r"(?<=\.) ")
    cues = F.transform(words, lambda w, i: F.struct((i * 4).cast("double").alias("t"), w.alias("text")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(segments.segments(cues)).alias("segment", "s"))
    return rows.select("doc_id", "segment", "s.start", F.length("s.text").alias("n"), F.md5("s.text").alias("digest"))


@query("txt01_lateral", _SEGMENTED)
def txt01_lateral(spark, sf_dir):
    """The same rows from SQL, by the table function transcript_segments."""
    tables.register(spark)
    cues = F.transform(F.split("text", r"(?<=\.) "), lambda w, i: F.struct((i * 4).cast("double").alias("t"), w.alias("text")))
    docs = table(spark, sf_dir, "documents").select("doc_id", cues.alias("cues"))
    return spark.sql("SELECT doc_id, s.segment, s.start, length(s.text) AS n, md5(s.text) AS digest FROM {docs}, LATERAL transcript_segments(cues) s", docs=docs)


@query("txt02", f"""WITH RECURSIVE c AS (SELECT conv_id, turn, trim(replace(text, chr(10), ' ')) AS text FROM conversations), f AS (SELECT * FROM c WHERE length(text) > 0), l AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM f),
 cues AS MATERIALIZED (SELECT conv_id AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn * 30.0 AS t, text AS w FROM l WHERE before IS NULL OR before <> text), {_BLOCKS}, u AS (SELECT *, 'https://example.org/watch?v=c' || k AS base, count(*) OVER (PARTITION BY k) AS parts FROM segments)
 SELECT left(sha256(base || '#seg' || segment), 16) AS id, base || '&t=' || start::BIGINT || 's' AS url, 'Conversation ' || k || ' [' || (segment + 1) || '/' || parts || ']' AS title, text AS content, segment FROM u""")
def txt02(spark, sf_dir):
    """Conversations as transcripts: rows of their segments with identity, address and title."""
    cues = cues_of(segments.clean_cues(table(spark, sf_dir, "conversations"), "conv_id", "turn").select(F.col("conv_id").alias("video"), F.col("turn").alias("pos"), (F.col("turn") * 30.0).alias("t"), "text"))
    videos = cues.select(F.concat(F.lit("https://example.org/watch?v=c"), F.col("video").cast("string")).alias("url"), F.concat(F.lit("Conversation "), F.col("video").cast("string")).alias("title"), "cues")
    return segments.segment_rows(videos)


@query("txt04", "SELECT doc_id, '  ' || text || ' некстати ' || ' .' AS text FROM documents")
def txt04(spark, sf_dir):
    """Spoken particles taken out: one before each text, one in capitals behind it, and a word that only holds one, which stays."""
    one = lambda n: F.element_at(F.array(*[F.lit(w) for w in lexical.ORAL]), (F.col("doc_id") % n + 1).cast("int"))
    text = F.concat(one(len(lexical.ORAL)), F.lit(" "), "text", F.lit(" некстати "), F.upper(one(7)), F.lit("."))
    return table(spark, sf_dir, "documents").select("doc_id", lexical.without_particles(text).alias("text"))


_GATE = "regexp_matches(lower(coalesce(content, '')), 'idiot|ungkeit|tion')"


@query("flt06", f"{VIEWS} SELECT source_kind, count(*) FILTER ({_GATE})::BIGINT AS gated FROM A GROUP BY 1")
def flt06(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("source_kind").agg(F.count_if(F.coalesce(F.col("content"), F.lit("")).rlike("(?iu)idiot|ungkeit|tion")).alias("gated"))


_NAMED = ["Украины", "недели", "тираны", "Дели", "США", "кот", "ЕС", "лес"]


@query("flt06_targets", "SELECT doc_id, doc_id % 8 IN (0, 3, 4, 6) AS gated FROM documents")
def flt06_targets(spark, sf_dir):
    """The gate of the sixteen targets, on texts that each end in a Russian word."""
    word = F.element_at(F.array(*[F.lit(w) for w in _NAMED]), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", filters.concerns_targets(F.concat_ws(" ", "text", word)).alias("gated"))


@query("flt07_political", "SELECT doc_id, doc_id % 5 IN (0, 2, 4) AS political FROM documents")
def flt07_political(spark, sf_dir):
    """The political roots, on texts that each end in a Russian word."""
    word = F.element_at(F.array(*[F.lit(w) for w in ("Путинские", "ёлка", "военкомат", "котик", "Суд")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").withColumn("word", word).select("doc_id", filters.political("text", "word").alias("political"))


_HINTS = dict(zip(TARGETS, ["tion", "ment", "ung", "ción", "eau", "keit", "ing", "que", "ado", "sch", "hea", "oi", "ble", "ver", "ra", "ent"], strict=True))
_COUNT = "(length(c) - length(replace(c, '{0}', ''))) // length('{0}')"


@query("txt10", f"""{VIEWS}, d AS (SELECT lower(coalesce(content, '')) AS c FROM A), l AS (SELECT c, regexp_matches(c, 'tion|ment|ung|ción') AS gate, {_COUNT.format("good")} + {_COUNT.format("the")} - {_COUNT.format("idiot")} - {_COUNT.format("stupid")} AS lean FROM d), w(target, word) AS (VALUES {", ".join(f"('{t}', '{w}')" for t, w in _HINTS.items())}),
 r AS (SELECT target, gate AND contains(c, word) AS hit, lean FROM l CROSS JOIN w) SELECT target, CASE WHEN NOT hit THEN 'non_concerne' WHEN lean > 0 THEN 'pro' WHEN lean < 0 THEN 'anti' ELSE 'neutre' END AS stance, count(*)::BIGINT AS n, round(avg(CASE WHEN hit THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, lean / 10::DOUBLE)) ELSE 0.0::DOUBLE END), 6) AS lean FROM r GROUP BY 1, 2""")
def txt10(spark, sf_dir):
    """Sixteen rows a document through a lexicon scorer: counts by target and stance."""
    targets = {t: [w] for t, w in _HINTS.items()}
    gate = F.coalesce(F.col("content"), F.lit("")).rlike("(?iu)tion|ment|ung|ción")
    rows = scoring.sentiment_rows(articles(spark, sf_dir), gate, lambda: scoring.LexiconScorer(targets, ["good", "the"], ["idiot", "stupid"]), TARGETS)
    return rows.groupBy("target", "stance").agg(F.count("*").alias("n"), F.round(F.avg("lean"), 6).alias("lean"))


_STANCES = ", ".join(f"count(*) FILTER (stance = '{s}') AS n{i}" for i, s in enumerate(stances.STANCES))


@query("txt10_learned", f"""{VIEWS}, v AS (SELECT article_id AS id, {_STANCES} FROM S WHERE stance <> 'non_concerne' AND doc_id % 5 <> 0 GROUP BY 1),
 w AS MATERIALIZED (SELECT DISTINCT id, replace(unnest(regexp_extract_all(lower(content), '[a-zA-Zа-яёА-ЯЁ][a-zA-Zа-яёА-ЯЁ\\-'']{{2,}}')), 'ё', 'е') AS token FROM A),
 tot AS (SELECT sum(n0) AS a0, sum(n1) AS a1, sum(n2) AS a2, a0 + a1 + a2 AS judged FROM v JOIN A USING (id) WHERE content IS NOT NULL), k AS MATERIALIZED (SELECT token, sum(n0) AS n0, sum(n1) AS n1, sum(n2) AS n2, (sum(n0) + sum(n1) + sum(n2)) / any_value(judged)::DOUBLE AS rate FROM w JOIN v USING (id), tot GROUP BY 1),
 lw AS MATERIALIZED (SELECT token, {", ".join(f"ln((n{i} + 2 * rate) / (a{i} + 2)) - ln(rate) AS w{i}" for i in range(3))} FROM k, tot WHERE round(2 * ({" + ".join(f"CASE WHEN n{i} > 0 THEN n{i} * ln(n{i} / (a{i} * rate)) ELSE 0 END" for i in range(3))}), 9) > 20), b AS (SELECT {", ".join(f"ln((a{i} + 0.5::DOUBLE) / (judged + 1.5::DOUBLE)) AS b{i}" for i in range(3))} FROM tot),
 g AS (SELECT id, sum(w0) AS s0, sum(w1) AS s1, sum(w2) AS s2 FROM w JOIN lw USING (token) GROUP BY 1), f AS (SELECT A.id, coalesce(content, '') AS content, {", ".join(f"round(coalesce(s{i}, 0) + b{i}, 9) AS f{i}" for i in range(3))} FROM A LEFT JOIN g USING (id), b), h(target, word) AS (VALUES {", ".join(f"('{t}', '{w}')" for t, w in _HINTS.items())}),
 r AS (SELECT target, (length(content) - length(replace(content, word, ''))) // length(word) AS hits, CASE WHEN f0 >= f1 AND f0 >= f2 THEN 'anti' WHEN f1 >= f2 THEN 'neutre' ELSE 'pro' END AS stance, (exp(f2 - greatest(f0, f1, f2)) - exp(f0 - greatest(f0, f1, f2))) / (exp(f0 - greatest(f0, f1, f2)) + exp(f1 - greatest(f0, f1, f2)) + exp(f2 - greatest(f0, f1, f2))) AS lean FROM f, h)
 SELECT target, CASE WHEN hits > 0 THEN stance ELSE 'non_concerne' END AS stance, count(*)::BIGINT AS n, round(avg(least(1.0::DOUBLE, hits / 10::DOUBLE)), 6) AS score, round(avg(CASE WHEN hits > 0 THEN lean ELSE 0.0::DOUBLE END), 6) AS lean FROM r GROUP BY 1, 2""")
def txt10_learned(spark, sf_dir):
    """A scorer learned from the judgements stored for four fifths of the articles, applied to all: counts by target and stance."""
    a = articles(spark, sf_dir)
    known = stances.learned(a, sentiment(spark, sf_dir).filter("doc_id % 5 <> 0"))
    rows = stances.stance_rows(a, known, _HINTS)
    return rows.groupBy("target", "stance").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"), F.round(F.avg("lean"), 6).alias("lean"))


@query("txt12", f"{VIEWS} SELECT topic_key::INTEGER AS topic_key, array_to_string(list_transform(string_split(top_words, ',')[1:3], lambda x: trim(x)), ' / ') AS label FROM T")
def txt12(spark, sf_dir):
    from pressloom.plans.articles import topic_names

    return topic_names(spark, sf_dir).select("topic_key", scoring.topic_label().alias("label"))


@query("txt13", f"{VIEWS}, j AS (SELECT topic_key, doc_id % 3 = 0 AS control, doc_id % 5 < 3 AS accepted FROM ASG WHERE portee = 'global' AND topic_key >= 0) SELECT topic_key::INTEGER AS topic_key, round(count(*) FILTER (accepted AND NOT control) / nullif(count(*) FILTER (NOT control), 0)::DOUBLE, 6) AS coherence, round(count(*) FILTER (NOT accepted AND control) / nullif(count(*) FILTER (control), 0)::DOUBLE, 6) AS distinction, count(*) FILTER (NOT control)::BIGINT AS n_test, count(*) FILTER (control)::BIGINT AS n_controle FROM j GROUP BY 1")
def txt13(spark, sf_dir):
    from pressloom.plans.articles import assignments

    a = assignments(spark, sf_dir).filter("portee = 'global' AND topic_key >= 0")
    return scoring.validation(a.select("topic_key", (F.col("doc_id") % 3 == 0).alias("control"), (F.col("doc_id") % 5 < 3).alias("accepted")))


@query("ml02_keywords", f"""{VIEWS}, f AS (SELECT ASG.topic_key AS topic, replace(unnest(regexp_extract_all(lower(content), '[a-zA-Zа-яёА-ЯЁ][a-zA-Zа-яёА-ЯЁ\\-'']{{2,}}')), 'ё', 'е') AS token FROM ASG JOIN A ON A.id = ASG.article_id WHERE portee = 'global' AND ASG.topic_key >= 0),
 n AS (SELECT topic, token, count(*) AS n FROM f GROUP BY ALL), w AS (SELECT token, sum(n) AS f FROM n GROUP BY 1), tt AS (SELECT topic, sum(n) AS t FROM n GROUP BY 1), xx AS (SELECT topic, token, round(n / t::DOUBLE * ln(1 + (SELECT avg(t) FROM tt) / f), 9) AS weight FROM n JOIN w USING (token) JOIN tt USING (topic)),
 r AS (SELECT topic::INTEGER AS topic, token, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, token)::INTEGER AS rank FROM xx) SELECT * FROM r WHERE rank <= 10""")
def ml02_keywords(spark, sf_dir):
    from pressloom.plans.articles import assignments

    a = assignments(spark, sf_dir).filter("portee = 'global' AND topic_key >= 0").select("article_id", F.col("topic_key").alias("topic"))
    t = a.join(articles(spark, sf_dir).select(F.col("id").alias("article_id"), "content"), "article_id").select("topic", F.explode(lexical.tokens(F.col("content"))).alias("token"))
    return lexical.ctfidf(t)


@query("win09", f"{VIEWS}, c AS (SELECT source_name, author AS auteur, count(*) AS n FROM A WHERE author IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY n DESC, auteur) AS r FROM c) SELECT source_name, auteur, n::BIGINT AS n FROM r WHERE r <= 10")
def win09(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("source_name").orderBy(F.desc("n"), "auteur"))
    return corpus.authors(articles(spark, sf_dir)).withColumn("r", rank).filter("r <= 10").drop("r")


@query("set06", f"{VIEWS}, c AS (SELECT source_name, author AS auteur, count(*) AS n FROM A WHERE author IS NOT NULL GROUP BY 1, 2), top AS (SELECT source_name FROM c GROUP BY 1 ORDER BY sum(n) DESC, source_name LIMIT 15), r AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY n DESC, auteur) AS r FROM c SEMI JOIN top USING (source_name)) SELECT source_name, auteur, n::BIGINT AS n, round(100.0::DOUBLE * n / (SELECT sum(n) FROM c), 2) AS pct FROM r WHERE r <= 10")
def set06(spark, sf_dir):
    """The tops of the largest sources put together: each one's first authors, with their part of all signed articles."""
    return corpus.treemap(corpus.authors(articles(spark, sf_dir)), "source_name", "auteur")
