"""Stance, joins on it, and drift between periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.operators import opinions, signals
from pressloom.plans.articles import AS_OF, VIEWS, articles, assignments, sentiment, techniques, topic_names
from pressloom.registry import query

TARGET = "otan"
_ON = "o AS (SELECT S.target, S.stance, S.score, S.lean, A.* FROM S JOIN A ON S.article_id = A.id)"
_LEAN = "sum(lean * score) / nullif(sum(score), 0)"
_C = f"WHERE target = '{TARGET}' AND stance <> 'non_concerne'"


def _rows(spark, sf_dir):
    return opinions.on_articles(sentiment(spark, sf_dir), articles(spark, sf_dir))


@query("join01", f"{VIEWS}, {_ON} SELECT target, source_kind, count(*)::BIGINT AS n FROM o GROUP BY ALL")
def join01(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy("target", "source_kind").agg(F.count("*").alias("n"))


@query("agg15", f"{VIEWS}, {_ON} SELECT stance, count(*)::BIGINT AS n FROM o WHERE target = '{TARGET}' GROUP BY 1")
def agg15(spark, sf_dir):
    return opinions.distribution(_rows(spark, sf_dir), TARGET)


@query("agg16", f"{VIEWS}, {_ON} SELECT round(coalesce({_LEAN}, avg(lean)), 6) AS avg_lean, count(*) FILTER (lean < -0.2)::BIGINT AS anti_count, count(*) FILTER (lean BETWEEN -0.2 AND 0.2)::BIGINT AS neutre_count, count(*) FILTER (lean > 0.2)::BIGINT AS pro_count, count(*)::BIGINT AS total FROM o {_C}")
def agg16(spark, sf_dir):
    return opinions.balance(_rows(spark, sf_dir), TARGET)


_P = "strftime(date_trunc('week', published_at), '%Y-%m-%d') AS periode"


@query("agg17", f"{VIEWS}, {_ON} SELECT {_P}, stance, count(*)::BIGINT AS n FROM o {_C} AND published_at IS NOT NULL GROUP BY 1, 2")
def agg17(spark, sf_dir):
    return opinions.over_time(_rows(spark, sf_dir), TARGET, "week")[0].withColumn("periode", F.date_format("periode", "yyyy-MM-dd"))


@query("agg17_lean", f"{VIEWS}, {_ON} SELECT {_P}, round({_LEAN}, 6) AS lean_avg, count(*)::BIGINT AS n FROM o {_C} AND published_at IS NOT NULL GROUP BY 1")
def agg17_lean(spark, sf_dir):
    return opinions.over_time(_rows(spark, sf_dir), TARGET, "week")[1].withColumn("periode", F.date_format("periode", "yyyy-MM-dd"))


@query("agg18", f"{VIEWS}, {_ON} SELECT source_name, " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (stance = '{s}') / count(*), 6) AS {s}" for s in ("pro", "neutre", "anti")) + f" FROM o {_C} GROUP BY 1")
def agg18(spark, sf_dir):
    return opinions.by_source(_rows(spark, sf_dir), TARGET)


_INF = f"i AS (SELECT target, count(*) FILTER (stance = 'pro')::BIGINT AS pro, count(*) FILTER (stance = 'anti')::BIGINT AS anti, count(*)::BIGINT AS mentions, round({_LEAN}, 6) AS lean_avg FROM o WHERE stance <> 'non_concerne' GROUP BY 1)"


@query("agg19", f"{VIEWS}, {_ON}, {_INF} SELECT * FROM i")
def agg19(spark, sf_dir):
    return opinions.influence(_rows(spark, sf_dir))


@query("agg19_extremes", f"{VIEWS}, {_ON}, {_INF} SELECT greatest(max(abs(coalesce(lean_avg, 0))), 0.1::DOUBLE) AS amplitude, (SELECT target FROM i ORDER BY abs(coalesce(lean_avg, 0)) DESC, target DESC LIMIT 1) AS extreme FROM i")
def agg19_extremes(spark, sf_dir):
    return opinions.extremes(opinions.influence(_rows(spark, sf_dir)))


_SRC = f"s2 AS (SELECT source_name, count(*)::BIGINT AS concerne, count(*) FILTER (stance = 'pro')::BIGINT AS pro, count(*) FILTER (stance = 'anti')::BIGINT AS anti, round({_LEAN}, 6) AS lean_avg FROM o {_C} GROUP BY 1 HAVING count(*) >= 3)"
for _mode, _value in (("pro", "round(100.0::DOUBLE * pro / concerne, 6)"), ("anti", 'round(100.0::DOUBLE * "anti" / concerne, 6)'), ("lean", "lean_avg")):

    @query("agg23" if _mode == "pro" else f"agg23_{_mode}", f"{VIEWS}, {_ON}, {_SRC} SELECT *, {_value} AS value FROM s2 ORDER BY value DESC NULLS LAST, source_name LIMIT 25")
    def agg23(spark, sf_dir, mode=_mode):
        return opinions.source_ranking(_rows(spark, sf_dir), TARGET, mode)


@query("agg24", f"""{VIEWS}, {_ON} SELECT trim(author) AS auteur, source_name, count(DISTINCT id)::BIGINT AS articles_concernes, round({_LEAN}, 3) AS lean_moyen, count(*) FILTER (stance = 'pro')::BIGINT AS pro, count(*) FILTER (stance = 'anti')::BIGINT AS anti, count(*) FILTER (stance = 'neutre')::BIGINT AS neutre
 FROM o {_C} AND author IS NOT NULL AND trim(author) <> '' GROUP BY 1, 2 HAVING count(DISTINCT id) >= 1 ORDER BY articles_concernes DESC, auteur, source_name LIMIT 40""")
def agg24(spark, sf_dir):
    return opinions.author_ranking(_rows(spark, sf_dir), TARGET, least=1)


@query("srt02", f"{VIEWS}, {_ON}, r AS (SELECT id AS article_id, stance, score, row_number() OVER (PARTITION BY stance ORDER BY score DESC, id) AS rank FROM o {_C}) SELECT article_id, stance, score, rank::INTEGER AS rank FROM r WHERE rank <= 15")
def srt02(spark, sf_dir):
    return opinions.strongest(_rows(spark, sf_dir), TARGET).select("article_id", "stance", "score", "rank")


@query("sig02", f"""{VIEWS}, n AS (SELECT count(*) FILTER (published_at >= DATE '{AS_OF}' - INTERVAL 13 DAY AND published_at < DATE '{AS_OF}' + INTERVAL 1 DAY)::BIGINT AS n_recent, count(*) FILTER (published_at >= DATE '{AS_OF}' - INTERVAL 27 DAY AND published_at < DATE '{AS_OF}' - INTERVAL 13 DAY)::BIGINT AS n_ref FROM A)
 SELECT *, round(n_recent / nullif(n_ref, 0)::DOUBLE, 6) AS ratio, n_recent >= 100 AND n_ref >= 100 AND round(n_recent / nullif(n_ref, 0)::DOUBLE, 6) BETWEEN 0.67 AND 1.5 AS comparable FROM n""")
def sig02(spark, sf_dir):
    return signals.volume_change(articles(spark, sf_dir), AS_OF, 14)


_FLAG = f"CASE WHEN published_at >= DATE '{AS_OF}' - INTERVAL 13 DAY AND published_at < DATE '{AS_OF}' + INTERVAL 1 DAY THEN 'recent' WHEN published_at >= DATE '{AS_OF}' - INTERVAL 27 DAY AND published_at < DATE '{AS_OF}' - INTERVAL 13 DAY THEN 'prior' END"


@query("sig01", f"{VIEWS} SELECT {_FLAG} AS w, source_kind, count(*)::BIGINT AS n FROM A WHERE {_FLAG} IS NOT NULL GROUP BY 1, 2")
def sig01(spark, sf_dir):
    rows = articles(spark, sf_dir).withColumn("w", signals.window_flag(F.col("published_at"), AS_OF, 14)).filter("w IS NOT NULL")
    return rows.groupBy("w", "source_kind").agg(F.count("*").alias("n"))


@query("sig05", f"{VIEWS}, f AS (SELECT *, {_FLAG} AS w FROM A) SELECT source_name, count(*) FILTER (w = 'recent')::BIGINT AS n_recent, count(*) FILTER (w = 'prior')::BIGINT AS n_prior, round(avg(length(content)) FILTER (w = 'recent'), 4) AS size_recent, round(avg(length(content)) FILTER (w = 'prior'), 4) AS size_prior FROM f WHERE w IS NOT NULL GROUP BY 1")
def sig05(spark, sf_dir):
    out = signals.compare_periods(articles(spark, sf_dir), "published_at", AS_OF, 14, ["source_name"], n=F.count(F.lit(1)), size=F.avg(F.length("content")))
    return out.select("source_name", *[F.coalesce(f"n_{w}", F.lit(0)).alias(f"n_{w}") for w in ("recent", "prior")], *[F.round(f"size_{w}", 4).alias(f"size_{w}") for w in ("recent", "prior")])


_MEAN = lambda w: f"sum(lean * score) FILTER (w = '{w}') / nullif(sum(score) FILTER (w = '{w}'), 0)"


@query("sig03", f"""{VIEWS}, {_ON}, f AS (SELECT *, {_FLAG} AS w FROM o WHERE stance <> 'non_concerne'), d AS (SELECT target, {_MEAN('prior')} AS p, {_MEAN('recent')} AS r, count(*) FILTER (w = 'prior')::BIGINT AS n_prior, count(*) FILTER (w = 'recent')::BIGINT AS n_recent FROM f GROUP BY 1)
 SELECT target, round(p, 6) AS lean_prior, round(r, 6) AS lean_recent, round(r - p, 6) AS delta, n_prior, n_recent FROM d WHERE n_prior >= 10 AND n_recent >= 10 ORDER BY abs(delta) DESC, target LIMIT 8""")
def sig03(spark, sf_dir):
    return signals.lean_drift(_rows(spark, sf_dir), AS_OF, 14)


@query("srt05", f"""{VIEWS}, {_ON}, f AS (SELECT *, {_FLAG} AS w FROM o WHERE stance <> 'non_concerne'), d AS (SELECT target, {_MEAN('prior')} AS p, {_MEAN('recent')} AS r, count(*) FILTER (w = 'prior') AS np, count(*) FILTER (w = 'recent') AS nr FROM f GROUP BY 1)
 SELECT target, round(r - p, 6) AS delta FROM d WHERE np >= 1 AND nr >= 1 ORDER BY abs(delta) DESC, target LIMIT 10""")
def srt05(spark, sf_dir):
    return signals.lean_drift(_rows(spark, sf_dir), AS_OF, 14, least=1, most=10).select("target", "delta")


@query("sig04", f"""{VIEWS}, g AS (SELECT T.label, {_FLAG.replace('published_at', 'A.published_at')} AS w FROM ASG JOIN T ON ASG.topic_key = T.topic_key JOIN A ON A.id = ASG.article_id WHERE ASG.portee = 'global'),
 n AS (SELECT label, count(*) FILTER (w = 'recent') AS r, count(*) FILTER (w = 'prior') AS p FROM g WHERE w IS NOT NULL GROUP BY 1), ss AS (SELECT label, coalesce(round(100.0::DOUBLE * r / nullif(sum(r) OVER (), 0), 6), 0) AS recent, coalesce(round(100.0::DOUBLE * p / nullif(sum(p) OVER (), 0), 6), 0) AS prior FROM n)
 SELECT label, recent, prior, round(recent - prior, 4) AS delta FROM ss ORDER BY abs(delta) DESC, label LIMIT 10""")
def sig04(spark, sf_dir):
    a = assignments(spark, sf_dir).filter("portee = 'global'").select("article_id", "topic_key").join(topic_names(spark, sf_dir).select("topic_key", "label"), "topic_key")
    rows = a.join(articles(spark, sf_dir).select(F.col("id").alias("article_id"), "published_at"), "article_id")
    return signals.share_drift(rows, "label", AS_OF, 14)


@query("join07", f"{VIEWS} SELECT A.id FROM A LEFT JOIN X ON A.id = X.article_id WHERE X.article_id IS NULL AND A.source_kind IN ('tv', 'youtube')")
def join07(spark, sf_dir):
    return articles(spark, sf_dir).filter("source_kind IN ('tv', 'youtube')").join(techniques(spark, sf_dir), F.col("id") == F.col("article_id"), "left_anti").select("id")


@query("join08", f"{VIEWS} SELECT id FROM A WHERE NOT EXISTS (SELECT 1 FROM S WHERE S.article_id = A.id AND S.stance <> 'non_concerne')")
def join08(spark, sf_dir):
    return articles(spark, sf_dir).join(sentiment(spark, sf_dir).filter("stance <> 'non_concerne'"), F.col("id") == F.col("article_id"), "left_anti").select("id")


@query("join09", f"{VIEWS} SELECT count(*)::BIGINT AS n FROM A WHERE EXISTS (SELECT 1 FROM S WHERE S.article_id = A.id AND S.stance <> 'non_concerne') AND NOT EXISTS (SELECT 1 FROM ASG WHERE ASG.article_id = A.id)")
def join09(spark, sf_dir):
    a = articles(spark, sf_dir).select("id")
    has = a.join(sentiment(spark, sf_dir).filter("stance <> 'non_concerne'").select(F.col("article_id").alias("id")), "id", "left_semi")
    return has.join(assignments(spark, sf_dir).select(F.col("article_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("n"))


@query("join10", f"{VIEWS} SELECT id FROM A WHERE id IN (SELECT article_id FROM X) AND id NOT IN (SELECT article_id FROM ASG WHERE topic_key = -1)")
def join10(spark, sf_dir):
    a = articles(spark, sf_dir).select("id").join(techniques(spark, sf_dir).select(F.col("article_id").alias("id")), "id", "left_semi")
    return a.join(assignments(spark, sf_dir).filter("topic_key = -1").select(F.col("article_id").alias("id")), "id", "left_anti")


@query("join13", f"""{VIEWS}, {_ON}, p AS (SELECT source_name, count(*)::BIGINT AS pro FROM o WHERE stance = 'pro' AND source_kind <> 'vk' GROUP BY 1), n AS (SELECT source_name, count(*)::BIGINT AS "anti" FROM o WHERE stance = 'anti' AND source_kind <> 'press' GROUP BY 1)
 SELECT source_name, coalesce(pro, 0)::BIGINT AS pro, coalesce("anti", 0)::BIGINT AS "anti" FROM p FULL JOIN n USING (source_name)""")
def join13(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    pro = rows.filter("stance = 'pro' AND source_kind <> 'vk'").groupBy("source_name").agg(F.count("*").alias("pro"))
    anti = rows.filter("stance = 'anti' AND source_kind <> 'press'").groupBy("source_name").agg(F.count("*").alias("anti"))
    return pro.join(anti, "source_name", "full").select("source_name", F.coalesce("pro", F.lit(0)).alias("pro"), F.coalesce("anti", F.lit(0)).alias("anti"))


@query("udaf01", f"{VIEWS}, {_ON} SELECT source_kind, round(pow(sum(score), 2) / nullif(sum(score * score), 0), 6) AS n_eff, round({_LEAN}, 6) AS lean FROM o WHERE stance <> 'non_concerne' GROUP BY 1")
def udaf01(spark, sf_dir):
    from pressloom.operators.weights import kish

    return _rows(spark, sf_dir).filter(opinions.concerned()).groupBy("source_kind").agg(F.round(kish("score"), 6).alias("n_eff"), F.round(opinions.weighted_lean(), 6).alias("lean"))
