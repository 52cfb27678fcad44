"""Joins, columns and changes that the other modules leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.functions import columns as c
from pressloom.functions import html, scoring
from pressloom.operators import corpus, filters, lexical, maintenance
from pressloom.plans.articles import AS_OF, PARENT, TECHNIQUES, VIEWS, WORDS, articles, assignments, sentiment, techniques
from pressloom.queries.rankings import _KL, _KL_COLUMNS
from pressloom.registry import query
from pressloom.sources.sinks import scratch_path, settled

_DAY = "'%d/%m/%Y %H:%M'"


@query("join05", f"""{VIEWS}, n AS (SELECT source_name, count(*) AS n FROM A GROUP BY 1), s1 AS (SELECT A.source_name, count(DISTINCT A.id) AS s FROM S JOIN A ON A.id = S.article_id WHERE stance = 'anti' GROUP BY 1), x1 AS (SELECT A.source_name, count(*) AS x FROM X JOIN A ON A.id = X.article_id GROUP BY 1)
 SELECT source_name, n::BIGINT AS n, coalesce(s, 0)::BIGINT AS s, coalesce(x, 0)::BIGINT AS x FROM n LEFT JOIN s1 USING (source_name) LEFT JOIN x1 USING (source_name)""")
def join05(spark, sf_dir):
    """Counts made before they are joined, so that no join fans out."""
    a = articles(spark, sf_dir).select("id", "source_name")
    of = lambda d: d.select(F.col("article_id").alias("id")).join(a, "id")
    s = of(sentiment(spark, sf_dir).filter("stance = 'anti'")).groupBy("source_name").agg(F.countDistinct("id").alias("s"))
    x = of(techniques(spark, sf_dir)).groupBy("source_name").agg(F.count("*").alias("x"))
    n = a.groupBy("source_name").agg(F.count("*").alias("n"))
    return n.join(s, "source_name", "left").join(x, "source_name", "left").select("source_name", "n", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("x", F.lit(0)).alias("x"))


@query("join06", f"{VIEWS}, v AS (SELECT source_name, max(view_count) AS top FROM A WHERE view_count > 1000 GROUP BY 1) SELECT DISTINCT source_name, top::BIGINT AS top FROM A LEFT JOIN v USING (source_name)")
def join06(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("source_name").distinct().join(a.filter("view_count > 1000").groupBy("source_name").agg(F.max("view_count").alias("top")), on="source_name", how="left")


@query("join11", f"{VIEWS}, p AS (SELECT source_kind, {PARENT} AS parent, max(view_count) AS v FROM A GROUP BY 1, 2) SELECT source_kind, count(*)::BIGINT AS n, (SELECT sum(v) FROM p WHERE p.source_kind = A.source_kind)::BIGINT AS vues FROM A GROUP BY source_kind")
def join11(spark, sf_dir):
    """A correlated sum as an aggregate that is joined."""
    a = articles(spark, sf_dir)
    views = a.groupBy("source_kind", corpus.parent().alias("parent")).agg(F.max("view_count").alias("v")).groupBy("source_kind").agg(F.sum("v").alias("vues"))
    return a.groupBy("source_kind").agg(F.count("*").alias("n")).join(views, "source_kind", "left")


@query("prj02", f"{VIEWS} SELECT id, {WORDS}::BIGINT AS mots FROM A")
def prj02(spark, sf_dir):
    return articles(spark, sf_dir).select("id", c.word_count(F.col("content")).alias("mots"))


@query("prj03", f"{VIEWS} SELECT id, left(content, 250) AS extrait FROM A")
def prj03(spark, sf_dir):
    return articles(spark, sf_dir).select("id", c.excerpt(F.col("content")).alias("extrait"))


@query("prj05", f"{VIEWS} SELECT DISTINCT source_name, CASE WHEN source_name IN ('src1', 'src2') THEN 'historic' ELSE '' END AS stance FROM A")
def prj05(spark, sf_dir):
    curated = articles(spark, sf_dir).filter("source_name IN ('src1', 'src2')").select("source_name", F.lit("historic").alias("stance")).distinct()
    return articles(spark, sf_dir).select("source_name").distinct().join(curated, "source_name", "left").select("source_name", F.coalesce("stance", F.lit("")).alias("stance"))


@query("flt10", f"{VIEWS} SELECT id FROM A WHERE source_kind IN ('tv', 'youtube') AND view_count >= 180 AND published_at >= DATE '{AS_OF}' - INTERVAL 20 DAY")
def flt10(spark, sf_dir):
    videos = articles(spark, sf_dir).filter("source_kind IN ('tv', 'youtube')").withColumn("duration", F.col("view_count"))
    return videos.filter(filters.video_floor(180, 20, AS_OF)).select("id")


@query("scl09", f"{VIEWS} SELECT source_name, round(100.0::DOUBLE * count(author) / nullif(count(*), 0), 1) AS pct FROM A GROUP BY 1")
def scl09(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("source_name").agg(c.share(F.count("author"), F.count("*"), 1).alias("pct"))


@query("scl11", f"{VIEWS} SELECT id, lower(coalesce(trim(author), '?')) || '/' || left(replace(url, 'https://', ''), 12) AS tag FROM A")
def scl11(spark, sf_dir):
    return articles(spark, sf_dir).select("id", F.concat(F.lower(F.coalesce(F.trim("author"), F.lit("?"))), F.lit("/"), F.left(F.replace("url", F.lit("https://"), F.lit("")), F.lit(12))).alias("tag"))


@query("scl20", f"{VIEWS} SELECT id, coalesce(strftime(published_at, {_DAY}), '') AS dt FROM A")
def scl20(spark, sf_dir):
    """Dates as readers write them, blank where missing."""
    return articles(spark, sf_dir).select("id", F.coalesce(F.date_format("published_at", "dd/MM/yyyy HH:mm"), F.lit("")).alias("dt"))


@query("scl24", "SELECT vec_id, len(embedding)::INTEGER AS n FROM embeddings WHERE len(embedding) > 0")
def scl24(spark, sf_dir):
    from pressloom.plans.articles import table

    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") > 0).select("vec_id", F.size("embedding").alias("n"))


@query("src05", f"{VIEWS} SELECT source_name, length(content)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY source_name, left(content, 80) ORDER BY length(content) DESC, doc_id) AS r FROM (SELECT source_name, doc_id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS content FROM A WHERE source_kind = 'telegram') WHERE length(content) >= 50) WHERE r = 1")
def src05(spark, sf_dir):
    """Posts put into channel pages, read back from their HTML, one for each beginning."""
    a = articles(spark, sf_dir).filter("source_kind = 'telegram'")
    escaped = F.replace(F.replace(F.replace("content", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    posts = a.select("source_name", "doc_id", F.concat(F.lit("<div class='message_text'>"), escaped, F.lit("</div>")).alias("html"))
    texts = posts.select("source_name", F.col("doc_id").alias("ordinal"), F.inline(html._posts("html")).alias("o", "text")).filter(F.length("text") >= 50)
    return html.longest_by_prefix(texts).select("source_name", F.length("text").cast("long").alias("n"))


_RECENT = f"published_at >= TIMESTAMP '2024-01-02' AND published_at < TIMESTAMP '2024-02-01' AND language = 'en' AND length(content) >= 200"
_RECENT_KL = _KL.replace("FROM A WHERE content IS NOT NULL", f"FROM A WHERE {_RECENT} AND (SELECT count(*) FROM A WHERE {_RECENT}) >= 100")


@query("txt06", f"{VIEWS}, {_RECENT_KL} SELECT {_KL_COLUMNS}, '{AS_OF}' AS run_date FROM r WHERE rang <= 60")
def txt06(spark, sf_dir):
    """Divergence over the last days of one language, if there are documents enough, stored by run date, twice: the rows of the run."""
    recent = articles(spark, sf_dir).filter(filters.article_filter("2024-01-02", AS_OF, language=["en"]) & (F.length("content") >= 200))
    enough = recent.agg((F.count("*") >= 100).alias("enough"))
    counts = lexical.axis_counts(recent, keep=settled).join(F.broadcast(enough)).filter("enough").drop("enough")
    rows = lexical.divergence(counts, keep=settled).withColumn("run_date", F.lit(AS_OF))
    path = scratch_path(spark, "divergence")
    for _ in range(2):
        maintenance.overwrite_partitions(rows, path, "run_date")
    return spark.read.schema(rows.schema).parquet(path)


@query("txt11", f"{VIEWS} SELECT id AS article_id, {'CASE doc_id % 15 ' + ' '.join(f'WHEN {i} THEN ' + repr(t) for i, t in enumerate(TECHNIQUES)) + ' END'} AS technique, least(1.0::DOUBLE, (doc_id % 13)::DOUBLE / 10) AS confiance FROM A WHERE source_kind IN ('tv', 'youtube')")
def txt11(spark, sf_dir):
    """Replies as a model gives them, read leniently: known techniques only, within bounds."""
    name = F.element_at(F.array(*[F.lit(t) for t in TECHNIQUES]), (F.col("doc_id") % 15 + 1).cast("int"))
    reply = F.concat(F.lit('```json\n{"techniques": [{"technique": "made up"}, {"technique": "'), name, F.lit('", "confiance": "'), (F.col("doc_id") % 13 / 10).cast("string"), F.lit('"}]}\n```'))
    return scoring.technique_rows(articles(spark, sf_dir).filter("source_kind IN ('tv', 'youtube')").select("id", reply.alias("reply")), TECHNIQUES).drop("extrait")


@query("str02", f"{VIEWS}, p AS (SELECT DISTINCT {PARENT} AS parent, doc_id // 100 AS g FROM A WHERE source_kind IN ('tv', 'youtube')) SELECT DISTINCT parent FROM p WHERE parent NOT IN (SELECT parent FROM p WHERE g % 2 = 0)")
def str02(spark, sf_dir):
    """Videos whose first segment isn't stored."""
    v = articles(spark, sf_dir).filter("source_kind IN ('tv', 'youtube')").select(corpus.parent().alias("parent"), F.expr("doc_id DIV 100").alias("g")).distinct()
    return v.select("parent").distinct().join(v.filter("g % 2 = 0").select("parent"), "parent", "left_anti")


@query("dml01", f"{VIEWS} SELECT id FROM A WHERE doc_id % 4 <> 0")
def dml01(spark, sf_dir):
    a = articles(spark, sf_dir).select("id", "url", "doc_id")
    return maintenance.insert_new(a.filter("doc_id % 4 = 0"), a).select("id")


@query("dml06", f"{VIEWS}, g AS (SELECT id FROM A WHERE source_kind = 'youtube' AND NOT coalesce(regexp_matches(lower(content), 'tion'), false)) SELECT (SELECT count(*) FROM A WHERE id NOT IN (SELECT id FROM g))::BIGINT AS articles, (SELECT count(*) FROM ASG WHERE article_id NOT IN (SELECT id FROM g))::BIGINT AS assignments")
def dml06(spark, sf_dir):
    a = articles(spark, sf_dir)
    gone = a.filter((F.col("source_kind") == "youtube") & ~filters.matches("tion")).select("id")
    left = maintenance.cascade({"articles": (a, "id"), "assignments": (assignments(spark, sf_dir), "article_id")}, gone)
    return left["articles"].agg(F.count("*").alias("articles")).join(left["assignments"].agg(F.count("*").alias("assignments")))
