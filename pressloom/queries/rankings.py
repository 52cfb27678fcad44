"""Sorts, limits, samples, domains and text tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.functions.columns import excerpt
from pressloom.operators import filters, lexical
from pressloom.plans.articles import VIEWS, articles, sentiment
from pressloom.registry import query
from pressloom.sources.sinks import settled


@query("srt01", f"{VIEWS} SELECT id, source_name, title FROM A ORDER BY published_at DESC NULLS LAST, id LIMIT 50")
def srt01(spark, sf_dir):
    return articles(spark, sf_dir).orderBy(F.col("published_at").desc_nulls_last(), "id").limit(50).select("id", "source_name", "title")



def explorer_order(name: str) -> list:
    """Sort keys of the explorer: recent, old, or source; nulls last in each."""
    return {"recent": [F.col("published_at").desc_nulls_last(), F.col("id")], "old": [F.col("published_at").asc_nulls_last(), F.col("id")], "source": [F.col("source_name").asc_nulls_last(), F.col("published_at").desc_nulls_last(), F.col("id")]}[name]


for _name, _sql in (("recent", "published_at DESC NULLS LAST, id"), ("old", "published_at ASC NULLS LAST, id"), ("source", "source_name ASC NULLS LAST, published_at DESC NULLS LAST, id")):

    @query(f"srt03_{_name}", f"{VIEWS} SELECT id, source_name, left(content, 250) AS extrait FROM A WHERE language = 'en' ORDER BY {_sql} LIMIT 200")
    def srt03(spark, sf_dir, order=_name):
        return articles(spark, sf_dir).filter("language = 'en'").orderBy(*explorer_order(order)).limit(200).select("id", "source_name", excerpt(F.col("content")).alias("extrait"))


@query("srt06", f"{VIEWS} SELECT id, title FROM A WHERE NOT EXISTS (SELECT 1 FROM S WHERE S.article_id = A.id AND stance <> 'non_concerne') ORDER BY published_at DESC NULLS LAST, id LIMIT 5")
def srt06(spark, sf_dir):
    done = sentiment(spark, sf_dir).filter("stance <> 'non_concerne'").select(F.col("article_id").alias("id"))
    return articles(spark, sf_dir).join(done, "id", "left_anti").orderBy(F.col("published_at").desc_nulls_last(), "id").limit(5).select("id", "title")


@query("srt07", f"{VIEWS} SELECT id FROM A ORDER BY md5(id || '42') LIMIT 20")
def srt07(spark, sf_dir):
    """A reproducible sample: by a hash of the id and a seed, whatever the order of the input."""
    return articles(spark, sf_dir).orderBy(F.md5(F.concat("id", F.lit("42")))).limit(20).select("id")


@query("srt11", f"{VIEWS} SELECT DISTINCT source_name, type_media FROM A ORDER BY 1, 2")
def srt11(spark, sf_dir):
    return articles(spark, sf_dir).select("source_name", "type_media").distinct().orderBy("source_name", "type_media")


_HIT = lambda p: f"coalesce(regexp_matches(lower(content), '{p}'), false)"


@query("agg30", f"{VIEWS} " + " UNION ALL ".join(f"SELECT 'stem' AS category, '{t}' AS term, count(*) FILTER ({_HIT(p)})::BIGINT AS articles, round(100.0::DOUBLE * count(*) FILTER ({_HIT(p)}) / count(*), 6) AS pct FROM A" for t, p in lexical.STEMS.items()))
def agg30(spark, sf_dir):
    return lexical.term_overview(articles(spark, sf_dir), lexical.STEMS)


_CURATED = {**lexical.FRAMING, **lexical.INDICATORS}


@query("agg30_curated", f"{VIEWS} " + " UNION ALL ".join(f"SELECT 'curated' AS category, '{t}' AS term, count(*) FILTER ({_HIT(p)})::BIGINT AS articles, round(100.0::DOUBLE * count(*) FILTER ({_HIT(p)}) / count(*), 6) AS pct FROM A" for t, p in _CURATED.items()))
def agg30_curated(spark, sf_dir):
    return lexical.term_overview(articles(spark, sf_dir), _CURATED, "curated")


@query("flt05", f"{VIEWS} SELECT id FROM A WHERE {_HIT('ment|ung')}")
def flt05(spark, sf_dir):
    return articles(spark, sf_dir).filter(filters.matches("ment|ung")).select("id")


@query("agg31", f"{VIEWS}, tt AS (SELECT strftime(date_trunc('day', published_at), '%Y-%m-%d') AS period, count(*)::BIGINT AS total, count(*) FILTER ({_HIT('ment')})::BIGINT AS n FROM A WHERE published_at IS NOT NULL GROUP BY 1) SELECT *, round(100.0::DOUBLE * n / total, 6) AS pct FROM tt")
def agg31(spark, sf_dir):
    return lexical.term_over_time(articles(spark, sf_dir), "ment", "day").withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query("agg31_sources", f"{VIEWS}, tt AS (SELECT source_name, type_media, count(*)::BIGINT AS total, count(*) FILTER ({_HIT('ment')})::BIGINT AS n FROM A GROUP BY 1, 2) SELECT *, round(100.0::DOUBLE * n / total, 6) AS pct FROM tt WHERE total >= 5 AND n > 0")
def agg31_sources(spark, sf_dir):
    return lexical.term_by_source(articles(spark, sf_dir), "ment")


_KL = """f AS (SELECT source_name, type_media, source_kind, replace(unnest(regexp_extract_all(lower(content), '[a-zA-Zа-яёА-ЯЁ][a-zA-Zа-яёА-ЯЁ\\-'']{2,}')), 'ё', 'е') AS token FROM A WHERE content IS NOT NULL),
 xx AS (SELECT 'type_media' AS axe, type_media AS groupe, source_name AS source, token FROM f UNION ALL SELECT 'source_kind', source_kind, source_name, token FROM f),
 b AS (SELECT axe, groupe, token, count(*) AS n, count(DISTINCT source) AS s FROM xx GROUP BY ALL), w AS (SELECT axe, token, sum(n) AS all_n FROM b GROUP BY ALL), v AS (SELECT axe, count(*) AS v, sum(all_n) AS axis_n FROM w GROUP BY ALL),
 g AS (SELECT axe, groupe, count(*) AS group_n, count(DISTINCT source) AS group_s FROM xx GROUP BY ALL),
 pq AS (SELECT b.*, (n + 0.5::DOUBLE) / (group_n + 0.5::DOUBLE * v) AS p, (all_n - n + 0.5::DOUBLE) / (axis_n - group_n + 0.5::DOUBLE * v) AS q FROM b JOIN g USING (axe, groupe) JOIN v USING (axe) JOIN w USING (axe, token) WHERE n >= 8 AND s >= least(3, group_s) AND axis_n > group_n),
 c AS (SELECT *, round(p * ln(p / q), 9) AS contribution FROM pq), r AS (SELECT *, row_number() OVER (PARTITION BY axe, groupe ORDER BY contribution DESC, token) AS rang FROM c WHERE contribution > 0)"""
_KL_COLUMNS = "axe, groupe, token, contribution, round(p * 10000, 6) AS freq_groupe, round(q * 10000, 6) AS freq_reste, n::BIGINT AS n_groupe, rang::INTEGER AS rang"


@query("txt05", f"{VIEWS}, {_KL} SELECT {_KL_COLUMNS} FROM r WHERE rang <= 60")
def txt05(spark, sf_dir):
    return lexical.divergence(lexical.axis_counts(articles(spark, sf_dir), keep=settled), keep=settled)


@query("win08", f"{VIEWS}, {_KL} SELECT axe, groupe, token, rang::INTEGER AS rang FROM r WHERE rang <= 5")
def win08(spark, sf_dir):
    return lexical.divergence(lexical.axis_counts(articles(spark, sf_dir), keep=settled), most=5, keep=settled).select("axe", "groupe", "token", "rang")


@query("srt10", f"{VIEWS}, {_KL} SELECT {_KL_COLUMNS} FROM r WHERE rang <= 25 AND axe = 'type_media'")
def srt10(spark, sf_dir):
    return lexical.divergence(lexical.axis_counts(articles(spark, sf_dir), keep=settled), keep=settled).filter("rang <= 25 AND axe = 'type_media'")


@query("txt03", f"{VIEWS}, f AS (SELECT source_kind, replace(unnest(regexp_extract_all(lower(content), '[a-zA-Zа-яёА-ЯЁ][a-zA-Zа-яёА-ЯЁ\\-'']{{2,}}')), 'ё', 'е') AS token FROM A) SELECT source_kind, count(*)::BIGINT AS n, count(DISTINCT token)::BIGINT AS vocabulary FROM f GROUP BY 1")
def txt03(spark, sf_dir):
    t = articles(spark, sf_dir).select("source_kind", F.explode(lexical.tokens(F.col("content"))).alias("token"))
    return t.groupBy("source_kind").agg(F.count("*").alias("n"), F.countDistinct("token").alias("vocabulary"))


_FOUND = "SELECT replace(unnest(regexp_extract_all(lower(content), '[a-zA-Zа-яёА-ЯЁ][a-zA-Zа-яёА-ЯЁ\\-'']{2,}')), 'ё', 'е') AS token FROM A"


@query("set01", f"{VIEWS}, f AS ({_FOUND}) SELECT unnest(['type_media', 'source_kind']) AS axe, count(DISTINCT token)::BIGINT AS v, count(*)::BIGINT AS axis_n FROM f")
def set01(spark, sf_dir):
    """The union of the vocabularies of each axis's groups: its words and their occurrences."""
    return lexical.vocabulary(lexical.axis_words(lexical.axis_counts(articles(spark, sf_dir))))
