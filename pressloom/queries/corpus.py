"""Filters, volumes, weights, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.functions.columns import block, period, share
from pressloom.operators import corpus, filters, weights
from pressloom.plans.articles import AS_OF, LANGUAGE, PARENT, VIEWS, WORDS, articles, assignments, sentiment, table, topic_names
from pressloom.registry import query

_day = lambda c, name: F.date_format(c, "yyyy-MM-dd").alias(name)


@query("agg01", f"{VIEWS} SELECT count(*)::BIGINT AS total, count(DISTINCT source_name)::BIGINT AS n_src, strftime(max(fetched_at), '%Y-%m-%d %H:%M') AS last_fetched FROM A")
def agg01(spark, sf_dir):
    return corpus.header(articles(spark, sf_dir))


@query("agg02", f"{VIEWS} SELECT source_kind, count(DISTINCT {PARENT})::BIGINT AS n FROM A GROUP BY source_kind")
def agg02(spark, sf_dir):
    return corpus.natural_units(articles(spark, sf_dir))


_VOLUMES = f"""by_parent AS (SELECT source_kind, source_name, {PARENT} AS parent, count(*) AS segments, sum({WORDS}) AS mots, max(view_count) AS vues, max(TRY_CAST(regexp_extract(url, '[?&#]t=(\\d+)', 1) AS INTEGER)) AS secondes, max(published_at) AS last FROM A GROUP BY ALL)"""


@query("agg03", f"{VIEWS}, {_VOLUMES} SELECT source_kind AS nature, count(*)::BIGINT AS unites, sum(segments)::BIGINT AS segments, sum(mots)::BIGINT AS mots, count(DISTINCT source_name)::BIGINT AS sources, sum(secondes)::BIGINT AS secondes, sum(vues)::BIGINT AS vues FROM by_parent GROUP BY source_kind")
def agg03(spark, sf_dir):
    return corpus.volumes(articles(spark, sf_dir), "source_kind").withColumnRenamed("source_kind", "nature").drop("last")


@query("agg04", f"""{VIEWS}, v AS (SELECT date_trunc('week', published_at) AS d, source_name, count(*) AS n FROM A WHERE published_at IS NOT NULL GROUP BY ALL),
 top AS (SELECT source_name FROM v GROUP BY source_name ORDER BY sum(n) DESC, source_name LIMIT 5)
 SELECT strftime(d, '%Y-%m-%d') AS jour, coalesce(top.source_name, 'others') AS display, sum(n)::BIGINT AS n FROM v LEFT JOIN top USING (source_name) GROUP BY 1, 2""")
def agg04(spark, sf_dir):
    return corpus.top_sources_over_time(articles(spark, sf_dir), "week").withColumn("jour", F.date_format("jour", "yyyy-MM-dd"))


_W = {
    "raw": "CAST(1.0 AS DOUBLE)",
    "source": "1.0::DOUBLE / count(*) OVER (PARTITION BY source_name)",
    "family": "1.0::DOUBLE / count(*) OVER (PARTITION BY coalesce(type_media, 'inconnu'))",
    "block": "1.0::DOUBLE / count(*) OVER (PARTITION BY type_media IN ('etat', 'para_etat'))",
    "family_source": "1.0::DOUBLE / (count(*) OVER (PARTITION BY source_name) * count(DISTINCT source_name) OVER (PARTITION BY coalesce(type_media, 'inconnu')))",
}


def _weights(name, scheme):
    @query(name, f"{VIEWS} SELECT id, round({_W[scheme]}, 9) AS w FROM A WHERE language = '{LANGUAGE}'")
    def run(spark, sf_dir):
        return weights.weighted(articles(spark, sf_dir).filter(F.col("language") == LANGUAGE), scheme).select("id", F.round("w", 9).alias("w"))


for _name, _scheme in (("win01", "raw"), ("win02", "source"), ("win03", "family"), ("win04", "block"), ("win05", "family_source")):
    _weights(_name, _scheme)


@query("win06", f"{VIEWS}, w AS (SELECT *, {_W['family_source']} AS w FROM A WHERE language = '{LANGUAGE}' AND source_kind IN ('press', 'tv')) SELECT type_media, round(sum(w), 6) AS sum_w, count(*)::BIGINT AS n FROM w GROUP BY type_media")
def win06(spark, sf_dir):
    rows = articles(spark, sf_dir).filter(filters.article_filter(language=[LANGUAGE], source_kind=["press", "tv"]))
    return weights.weighted(rows, "family_source").groupBy("type_media").agg(F.round(F.sum("w"), 6).alias("sum_w"), F.count("*").alias("n"))


@query("agg06", f"""{VIEWS}, w AS (SELECT *, {_W['family_source']} AS w FROM A) SELECT T.topic_key::INTEGER AS topic_key, label, source_kind AS decoupe, round(sum(w), 6) AS n, round(sum(w * length(content)), 4) AS chars
 FROM T JOIN ASG ON T.topic_key = ASG.topic_key JOIN w ON w.id = ASG.article_id WHERE ASG.portee = 'global' GROUP BY ALL""")
def agg06(spark, sf_dir):
    rows = weights.weighted(articles(spark, sf_dir), "family_source")
    return weights.weighted_topics(rows, assignments(spark, sf_dir).filter("portee = 'global'").select("article_id", "topic_key"), topic_names(spark, sf_dir).select("topic_key", "label"), F.col("source_kind"))


@query("agg07", f"{VIEWS}, w AS (SELECT *, {_W['family']} AS w FROM A WHERE language = '{LANGUAGE}') SELECT round(sum(w), 6) AS sum_w, round(sum(w * length(content)), 4) AS sum_w_chars, round(pow(sum(w), 2) / sum(w * w), 6) AS n_eff FROM w")
def agg07(spark, sf_dir):
    return weights.denominators(weights.weighted(articles(spark, sf_dir).filter(F.col("language") == LANGUAGE), "family"))


@query("agg08", f"""{VIEWS}, w AS (SELECT *, {_W['source']} AS w FROM A), st AS (SELECT type_media AS strate, count(*)::BIGINT AS docs, count(DISTINCT source_name)::BIGINT AS sources, sum(w) AS sw FROM w GROUP BY 1)
 SELECT strate, docs, sources, round(100.0::DOUBLE * sw / sum(sw) OVER (), 6) AS part, round(100.0::DOUBLE * sw / sum(sw) OVER (), 6) >= 10 AND (sources < 3 OR docs < 200) AS fragile FROM st""")
def agg08(spark, sf_dir):
    return weights.composition(weights.weighted(articles(spark, sf_dir), "source"), F.col("type_media"))


@query("agg20", f"{VIEWS} SELECT type_media, count(*)::BIGINT AS n, sum(length(content))::BIGINT AS signes FROM A GROUP BY type_media")
def agg20(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("type_media").agg(F.count("*").alias("n"), F.sum(F.length("content")).cast("long").alias("signes"))


@query("agg20_sources", f"{VIEWS} SELECT type_media, source_kind AS nature, source_name, count(*)::BIGINT AS n FROM A GROUP BY ALL ORDER BY n DESC, type_media, nature, source_name LIMIT 25")
def agg20_sources(spark, sf_dir):
    n = articles(spark, sf_dir).groupBy("type_media", F.col("source_kind").alias("nature"), "source_name").agg(F.count("*").alias("n"))
    return corpus.ranked(n, ["type_media", "nature", "source_name"], 25)


@query("agg21", f"{VIEWS} SELECT source_name AS source, type_media, statut_legal_ru, source_kind AS nature, count(*)::BIGINT AS n FROM A GROUP BY ALL")
def agg21(spark, sf_dir):
    return articles(spark, sf_dir).groupBy(F.col("source_name").alias("source"), "type_media", "statut_legal_ru", F.col("source_kind").alias("nature")).agg(F.count("*").alias("n"))


_AUTHORS = "auth AS (SELECT source_name, trim(author) AS auteur, count(*)::BIGINT AS n FROM A WHERE author IS NOT NULL AND trim(author) <> '' GROUP BY 1, 2 HAVING count(*) >= 1)"


@query("agg22", f"{VIEWS}, {_AUTHORS} SELECT * FROM auth")
def agg22(spark, sf_dir):
    return corpus.authors(articles(spark, sf_dir))


@query("agg25", f"""{VIEWS}, {_AUTHORS}, top AS (SELECT source_name FROM auth GROUP BY 1 ORDER BY sum(n) DESC, source_name LIMIT 15),
 r AS (SELECT auth.*, row_number() OVER (PARTITION BY source_name ORDER BY n DESC, auteur) AS r, (SELECT sum(n) FROM auth) AS t FROM auth SEMI JOIN top USING (source_name))
 SELECT source_name, auteur, n, round(100.0::DOUBLE * n / t, 6) AS pct FROM r WHERE r <= 10""")
def agg25(spark, sf_dir):
    return corpus.hierarchy(corpus.authors(articles(spark, sf_dir)))


@query("agg25_top", f"{VIEWS}, {_AUTHORS} SELECT auteur, sum(n)::BIGINT AS n FROM auth GROUP BY 1 ORDER BY n DESC, auteur LIMIT 40")
def agg25_top(spark, sf_dir):
    return corpus.ranked(corpus.authors(articles(spark, sf_dir)).groupBy("auteur").agg(F.sum("n").alias("n")), ["auteur"], 40)


@query("agg39", f"{VIEWS} SELECT round(100.0::DOUBLE * count(author) / count(*), 6) AS pct, count(DISTINCT author)::BIGINT AS authors FROM A")
def agg39(spark, sf_dir):
    return articles(spark, sf_dir).agg(share(F.count("author"), F.count("*")).alias("pct"), F.countDistinct("author").alias("authors"))


_DONE = """s1 AS (SELECT DISTINCT article_id FROM S WHERE stance <> 'non_concerne'), t1 AS (SELECT DISTINCT article_id FROM ASG),
 p AS (SELECT A.*, s1.article_id AS s, t1.article_id AS t FROM A LEFT JOIN s1 ON A.id = s1.article_id LEFT JOIN t1 ON A.id = t1.article_id)"""


def _processed(spark, sf_dir):
    return articles(spark, sf_dir), sentiment(spark, sf_dir).filter("stance <> 'non_concerne'"), assignments(spark, sf_dir)


_LONG = "content IS NOT NULL AND length(content) >= CASE WHEN source_kind = 'telegram' THEN 50 ELSE 300 END"
_COVERAGE = f"""{_DONE}, n AS (SELECT source_name AS source, count(*) AS total, count(*) FILTER ({_LONG}) AS long, count(*) FILTER (trim(author) <> '') AS named, count(s) AS s, count(t) AS t FROM p WHERE published_at >= TIMESTAMP '2024-01-01' GROUP BY 1),
 pct AS (SELECT source, total::BIGINT AS articles, round(100.0 * long / total)::INTEGER AS contenu, round(100.0 * named / total)::INTEGER AS auteur, round(100.0 * s / nullif(long, 0))::INTEGER AS sentiment, round(100.0 * t / nullif(long, 0))::INTEGER AS themes FROM n),
 v AS (SELECT *, least(sentiment, themes) AS analyses, CASE WHEN contenu < 80 OR least(sentiment, themes) < 80 THEN 'PROBLÈME' WHEN contenu < 95 OR least(sentiment, themes) < 95 THEN 'ATTENTION' ELSE 'OK' END AS statut FROM pct)"""


def _coverage(spark, sf_dir):
    a, s, t = _processed(spark, sf_dir)
    return corpus.coverage(a.filter(filters.article_filter("2024-01-01")), s, t)


@query("agg26", f"{VIEWS}, {_COVERAGE} SELECT * FROM v")
def agg26(spark, sf_dir):
    """Coverage of the last thirty days."""
    return _coverage(spark, sf_dir)


@query("udaf02", f"{VIEWS}, {_COVERAGE} SELECT statut, count(*)::BIGINT AS sources, sum(articles)::BIGINT AS articles FROM v GROUP BY 1")
def udaf02(spark, sf_dir):
    """Sources, and their articles, of each status."""
    return _coverage(spark, sf_dir).groupBy("statut").agg(F.count("*").alias("sources"), F.sum("articles").alias("articles"))


@query("agg27", f"""{VIEWS}, {_DONE}, n AS (SELECT strftime(date_trunc('week', published_at), '%Y-%m-%d') AS period, count(*) AS total, count(*) FILTER ({_LONG}) AS long, count(s) AS s, count(t) AS t FROM p WHERE published_at >= TIMESTAMP '2024-01-08' GROUP BY 1)
 SELECT period, total::BIGINT AS total, round(100.0::DOUBLE * long / total, 1) AS contenu, round(100.0::DOUBLE * s / nullif(long, 0), 1) AS sentiment, round(100.0::DOUBLE * t / nullif(long, 0), 1) AS themes FROM n""")
def agg27(spark, sf_dir):
    a, s, t = _processed(spark, sf_dir)
    rows = corpus.coverage_over_time(a.filter(filters.article_filter("2024-01-08")), s, t)
    return rows.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query("agg28", f"""{VIEWS} SELECT source_name AS source, type_media, count(*)::BIGINT AS articles, count(DISTINCT CASE WHEN source_kind IN ('youtube', 'tv') THEN {PARENT} END)::BIGINT AS videos, strftime(min(published_at), '%Y-%m-%d') AS "first", strftime(max(published_at), '%Y-%m-%d') AS "last",
 count(*) FILTER (published_at >= DATE '{AS_OF}' - INTERVAL 7 DAY)::BIGINT AS recent_7d, count(DISTINCT author)::BIGINT AS authors, count(DISTINCT language)::BIGINT AS languages FROM A GROUP BY 1, 2""")
def agg28(spark, sf_dir):
    return corpus.overview(articles(spark, sf_dir), AS_OF)


@query("agg29", f"{VIEWS} SELECT source_name, count(*)::BIGINT AS n FROM A WHERE title ILIKE '%de%' OR content ILIKE '%de%' GROUP BY 1")
def agg29(spark, sf_dir):
    return articles(spark, sf_dir).filter(filters.simple_filter(text="de")).groupBy("source_name").agg(F.count("*").alias("n"))


@query("agg33", f"""{VIEWS}, {_VOLUMES} SELECT source_name AS source, source_kind AS nature, count(*)::BIGINT AS unites, sum(segments)::BIGINT AS segments, sum(mots)::BIGINT AS mots, strftime(max(last), '%Y-%m-%d') AS dernier, sum(secondes)::BIGINT AS secondes, sum(vues)::BIGINT AS vues FROM by_parent GROUP BY 1, 2""")
def agg33(spark, sf_dir):
    v = corpus.volumes(articles(spark, sf_dir), "source_name", "source_kind")
    return v.select(F.col("source_name").alias("source"), F.col("source_kind").alias("nature"), "unites", "segments", "mots", _day("last", "dernier"), "secondes", "vues")


_OK = f"content IS NOT NULL AND language = '{LANGUAGE}' AND ((source_kind = 'telegram' AND length(content) >= 50) OR (source_kind <> 'telegram' AND length(content) >= 300))"


def _eligible(spark, sf_dir):
    from pressloom.functions.columns import eligible

    return articles(spark, sf_dir).filter(eligible(F.col("content"), F.col("source_kind"), F.col("language"), LANGUAGE))


@query("agg34", f"{VIEWS}, {_DONE} SELECT unnest(['sentiment', 'themes']) AS label, count(*)::BIGINT AS eligible, unnest([count(s), count(t)])::BIGINT AS processed, (count(*) - unnest([count(s), count(t)]))::BIGINT AS missing FROM p WHERE {_OK}")
def agg34(spark, sf_dir):
    _, s, t = _processed(spark, sf_dir)
    n = corpus.processed(_eligible(spark, sf_dir), F.lit("all").alias("k"), s, t)
    rows = n.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("processed")) for c in ("sentiment", "themes")])).alias("r"))
    return rows.select("r.label", F.col("total").alias("eligible"), "r.processed", (F.col("total") - F.col("r.processed")).alias("missing"))


@query("agg35", f"{VIEWS} SELECT source_name, count(*)::BIGINT AS total, count(*) FILTER (published_at IS NULL)::BIGINT AS sans_date, round(100.0::DOUBLE * count(*) FILTER (published_at IS NULL) / count(*), 6) AS pct_null FROM A GROUP BY 1 HAVING count(*) FILTER (published_at IS NULL) > 0")
def agg35(spark, sf_dir):
    n = articles(spark, sf_dir).groupBy("source_name").agg(F.count("*").alias("total"), F.count_if(F.col("published_at").isNull()).alias("sans_date")).filter("sans_date > 0")
    return n.withColumn("pct_null", share(F.col("sans_date"), F.col("total"))).orderBy(F.desc("pct_null"), "source_name")


@query("agg36", f"""{VIEWS} SELECT source_name, count(*)::BIGINT AS total, strftime(max(published_at), '%Y-%m-%d %H:%M') AS "last", count(*) FILTER (published_at IS NULL)::BIGINT AS no_date, count(*) FILTER (content IS NULL OR content = '')::BIGINT AS no_content,
 count(*) FILTER (published_at >= DATE '{AS_OF}' - INTERVAL 7 DAY)::BIGINT AS recent7, round(avg(length(content)), 4) AS avg_len FROM A GROUP BY 1""")
def agg36(spark, sf_dir):
    recent = F.col("published_at") >= F.date_sub(F.lit(AS_OF).cast("date"), 7).cast("timestamp")
    return articles(spark, sf_dir).groupBy("source_name").agg(F.count("*").alias("total"), F.date_format(F.max("published_at"), "yyyy-MM-dd HH:mm").alias("last"), F.count_if(F.col("published_at").isNull()).alias("no_date"), F.count_if(F.col("content").isNull() | (F.col("content") == "")).alias("no_content"), F.count_if(recent).alias("recent7"), F.round(F.avg(F.length("content")), 4).alias("avg_len"))


@query("agg36_languages", f"{VIEWS} SELECT source_name, language, count(*)::BIGINT AS n FROM A GROUP BY ALL")
def agg36_languages(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("source_name", "language").agg(F.count("*").alias("n"))


@query("agg37", f"{VIEWS} SELECT strftime(published_at, '%Y-%m-%d') AS day, count(*)::BIGINT AS n FROM A WHERE source_name = 'src3' AND published_at IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 7")
def agg37(spark, sf_dir):
    return articles(spark, sf_dir).filter("source_name = 'src3' AND published_at IS NOT NULL").groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(7)


@query("agg38", f"""{VIEWS} SELECT {PARENT} AS video_id, source_name AS source, min(regexp_replace(title, ' \\[\\d+/\\d+\\]$', '')) AS titre, count(*)::BIGINT AS segments, sum(length(content))::BIGINT AS signes FROM A WHERE source_kind IN ('youtube', 'tv') GROUP BY 1, 2""")
def agg38(spark, sf_dir):
    from pressloom.functions.columns import strip_part

    rows = articles(spark, sf_dir).filter("source_kind IN ('youtube', 'tv')")
    return rows.groupBy(corpus.parent().alias("video_id"), F.col("source_name").alias("source")).agg(F.min(strip_part(F.col("title"))).alias("titre"), F.count("*").alias("segments"), F.sum(F.length("content")).cast("long").alias("signes"))


@query("win07", """WITH t AS (SELECT DISTINCT ts FROM events WHERE ts IS NOT NULL), g AS (SELECT ts, CASE WHEN lag(ts) OVER (ORDER BY ts) IS NULL OR ts - lag(ts) OVER (ORDER BY ts) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM t) SELECT sum(fresh)::BIGINT AS n_runs FROM g""")
def win07(spark, sf_dir):
    return corpus.collection_runs(table(spark, sf_dir, "events"), "ts").agg(F.count("*").alias("n_runs"))


@query("str05", """WITH t AS (SELECT DISTINCT ts FROM events WHERE ts IS NOT NULL), g AS (SELECT ts, CASE WHEN lag(ts) OVER (ORDER BY ts) IS NULL OR ts - lag(ts) OVER (ORDER BY ts) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM t),
 r AS (SELECT ts, sum(fresh) OVER (ORDER BY ts) AS run FROM g), e AS (SELECT run, count(*) AS n FROM events JOIN r USING (ts) GROUP BY run) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS "start", strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end", any_value(e.n)::BIGINT AS n FROM r JOIN e USING (run) GROUP BY run""")
def str05(spark, sf_dir):
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return corpus.collection_runs(table(spark, sf_dir, "events"), "ts").select(f("start"), f("end"), "n")


@query("win10", f"{VIEWS} SELECT topic_key::INTEGER AS topic_key, ((topic_key * 7) % 11)::INTEGER AS jx, ((topic_key * 13) % 11)::INTEGER AS jy FROM T")
def win10(spark, sf_dir):
    return topic_names(spark, sf_dir).select("topic_key", ((F.col("topic_key") * 7) % 11).alias("jx"), ((F.col("topic_key") * 13) % 11).alias("jy"))


@query("flt01", f"{VIEWS} SELECT id FROM A WHERE published_at >= TIMESTAMP '2024-01-05' AND published_at < TIMESTAMP '2024-01-21' AND language IN ('en', 'fr') AND source_kind IN ('press', 'tv', 'vk') AND type_media IN ('etat', 'exil')")
def flt01(spark, sf_dir):
    return articles(spark, sf_dir).filter(filters.article_filter("2024-01-05", "2024-01-20", language=["en", "fr"], source_kind=["press", "tv", "vk"], type_media=["etat", "exil"], statut_legal_ru=[])).select("id")


@query("flt02", f"{VIEWS} SELECT source_kind, count(*)::BIGINT AS n FROM A WHERE language IN ('en') AND type_media IN ('etat') GROUP BY 1")
def flt02(spark, sf_dir):
    return articles(spark, sf_dir).filter(filters.article_filter(language=["en"], type_media=["etat"])).groupBy("source_kind").agg(F.count("*").alias("n"))


_T = lambda t: f"(strip_accents(title) ILIKE '%{t}%' OR strip_accents(content) ILIKE '%{t}%')"


@query("flt03", f"{VIEWS} SELECT id FROM A WHERE ({_T('tion')} AND {_T('the and')}) OR ({_T('cion')} AND NOT {_T('queado')})")
def flt03(spark, sf_dir):
    return articles(spark, sf_dir).filter(filters.article_filter(search='tion "the and" OU (ción -queado)')).select("id")


def _found(spark, sf_dir, search, default="AND"):
    return articles(spark, sf_dir).filter(filters.article_filter(search=search, default=default)).select("id")


@query("flt03a", f"{VIEWS} SELECT id FROM A WHERE {_T('tion')} AND {_T('the and')} AND NOT {_T('queado')} OR {_T('ungkeit')} AND NOT {_T('zzz')}")
def flt03a(spark, sf_dir):
    """Phrases, parentheses, every sign of the operators, a dash for not."""
    return _found(spark, sf_dir, '(tion && "the and" -queado) | ungkeit SAUF zzz')


@query("flt03b", f"{VIEWS} SELECT id FROM A WHERE {_T('tion')} OR ({_T('ment')} AND NOT {_T('queado')})")
def flt03b(spark, sf_dir):
    """Neighbours take the default operator, a not always and."""
    return _found(spark, sf_dir, "tion ment NOT queado", "OR")


@query("flt03c", f"{VIEWS} SELECT id FROM A WHERE {_T('cion')} OR {_T('m_nt%er')}")
def flt03c(spark, sf_dir):
    """Accents and case aside; a term's % and _ are wildcards."""
    return _found(spark, sf_dir, "CIÓN OU m_nt%er")


@query("flt03d", f"{VIEWS} SELECT id FROM A WHERE {_T('tion')} AND ({_T('ment')} OR true)")
def flt03d(spark, sf_dir):
    """A missing operand is true, an open parenthesis ends with the text, what follows a stray one is not read."""
    return _found(spark, sf_dir, "tion AND (ment OR")


@query("flt04", f"{VIEWS} SELECT source_kind, count(*)::BIGINT AS n FROM A WHERE {_OK} GROUP BY 1")
def flt04(spark, sf_dir):
    return _eligible(spark, sf_dir).groupBy("source_kind").agg(F.count("*").alias("n"))


@query("flt07", f"{VIEWS} SELECT id FROM A WHERE contains(replace(lower(concat_ws(' ', title, content)), 'ё', 'е'), 'idiot') OR contains(replace(lower(concat_ws(' ', title, content)), 'ё', 'е'), 'ungkeit')")
def flt07(spark, sf_dir):
    return articles(spark, sf_dir).filter(filters.any_stem(["idiot", "ungkeit"], "title", "content")).select("id")


@query("flt09", f"{VIEWS} SELECT id FROM A WHERE source_name = 'src1' AND (title ILIKE '%er%' OR content ILIKE '%er%') AND published_at >= TIMESTAMP '2024-01-03'")
def flt09(spark, sf_dir):
    return articles(spark, sf_dir).filter(filters.simple_filter("src1", "er", "2024-01-03")).select("id")


@query("flt11", f"{VIEWS} SELECT source_name, count(*)::BIGINT AS n FROM A WHERE (content IS NULL OR length(content) < CASE WHEN source_kind = 'telegram' THEN 50 ELSE 300 END) AND url IS NOT NULL GROUP BY 1")
def flt11(spark, sf_dir):
    return articles(spark, sf_dir).filter(filters.missing_content()).groupBy("source_name").agg(F.count("*").alias("n"))


@query("flt12", f"{VIEWS} SELECT id FROM A WHERE published_at IS NULL AND content IS NOT NULL")
def flt12(spark, sf_dir):
    return articles(spark, sf_dir).filter("published_at IS NULL AND content IS NOT NULL").select("id")


@query("flt13", f"{VIEWS} SELECT DISTINCT source_name FROM A WHERE source_name ILIKE '%src1%' ORDER BY 1 LIMIT 5")
def flt13(spark, sf_dir):
    return filters.source_like(articles(spark, sf_dir), "SRC1 and more")


@query("prj04", f"{VIEWS} SELECT CASE WHEN type_media IN ('etat', 'para_etat') THEN 'aligne_etat' ELSE 'independant_exil' END AS decoupe, count(*)::BIGINT AS n FROM A GROUP BY 1")
def prj04(spark, sf_dir):
    axes = {"nature": F.col("source_kind"), "block": block(F.col("type_media")), "media": F.col("type_media"), "source": F.col("source_name"), "none": F.lit("all")}
    return articles(spark, sf_dir).groupBy(axes["block"].alias("decoupe")).agg(F.count("*").alias("n"))
