"""The article view and its enrichment tables, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions.columns import url_hash

AS_OF = "2024-01-31"
LANGUAGE = "en"
# Names of kinds, media types, legal states, targets, techniques.
KINDS = ["press", "telegram", "tv", "youtube", "vk"]
TYPES = ["etat", "para_etat", "independant", "exil"]
LEGAL = ["aucun", "agent_etranger", "organisation_indesirable"]
TARGETS = ["ukraine", "etats_unis", "union_europeenne", "otan", "allemagne", "france", "pays_baltes", "chine", "inde", "brics_global_south", "georgie", "opposition_russe", "kazakhstan", "armenie", "moldavie", "iran"]
TECHNIQUES = ["langage_charge", "etiquetage", "appel_a_la_peur", "exageration", "doute", "drapeau", "simplification_causale", "slogan", "appel_a_l_autorite", "noir_ou_blanc", "cliche_final", "whataboutisme", "reductio_ad_hitlerum", "homme_de_paille", "diversion"]


def _pick(names: list[str], i: str) -> str:
    return f"element_at(array({', '.join(repr(n) for n in names)}), CAST({i} AS INT) + 1)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "lang", "source", "CAST(substr(source, 4) AS BIGINT) AS sn", "doc_id DIV 100 AS pn", "(doc_id DIV 20) % 5 AS q")
    kind = docs.withColumn("source_kind", F.expr(_pick(KINDS, "sn % 5"))).withColumn("video", F.col("source_kind").isin("youtube", "tv"))
    return kind.select(
        url_hash(F.expr("'doc://' || doc_id")).alias("id"),
        "doc_id",
        F.col("source").alias("source_name"),
        "source_kind",
        F.expr(_pick(TYPES, "(sn DIV 5) % 4")).alias("type_media"),
        F.expr(_pick(LEGAL, "sn % 3")).alias("statut_legal_ru"),
        F.expr("CASE source_kind WHEN 'youtube' THEN 'https://example.org/watch?v=v' || sn || '_' || pn || '&t=' || (90 * q) || 's' WHEN 'tv' THEN 'https://example.org/video/x' || sn || 'p' || pn || '/?t=' || (90 * q) ELSE 'https://example.org/a/' || doc_id END").alias("url"),
        F.expr("left(split_part(text, '\n', 1), 120) || CASE WHEN video THEN ' [' || (q + 1) || '/5]' ELSE '' END").alias("title"),
        F.expr("CASE WHEN doc_id % 41 = 0 THEN NULL ELSE text END").alias("content"),
        F.col("lang").alias("language"),
        F.expr("CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Author ' || (doc_id % 23) END").alias("author"),
        F.expr("CASE WHEN doc_id % 97 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST((37 * doc_id) % 43200 AS INT)) END").alias("published_at"),
        F.expr("CASE WHEN doc_id % 97 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 01:00:00' + make_dt_interval(0, 0, CAST((37 * doc_id) % 43200 AS INT)) END").alias("fetched_at"),
        F.expr("CASE WHEN video THEN (131 * pn + 17 * sn) % 5000 END").alias("view_count"),
    )


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, target, stance, score, lean: two targets a document, stance from its labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    stance = F.expr("CASE WHEN toxic = 1 THEN 'anti' WHEN quality = 1 THEN 'pro' WHEN quality = 0 THEN 'neutre' ELSE 'non_concerne' END")
    rows = docs.select(url_hash(F.expr("'doc://' || doc_id")).alias("article_id"), "doc_id", stance.alias("stance"), F.expr("explode(array(doc_id % 16, (doc_id % 16 + 5) % 16))").alias("t"))
    lean = F.expr("CASE stance WHEN 'pro' THEN 0.6D WHEN 'anti' THEN -0.7D WHEN 'neutre' THEN 0.05D ELSE 0.0D END")
    return rows.select("article_id", "doc_id", F.expr(_pick(TARGETS, "t")).alias("target"), "stance", F.expr("CAST(doc_id % 10 AS DOUBLE) / 10").alias("score"), lean.alias("lean"))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, topic_key, probability, run_date, portee: a document's topic in the whole and in its kind; -1 is noise."""
    rows = articles(spark, sf_dir).select("id", "doc_id", "published_at", "source_kind").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    key = F.when(F.col("label") == 0, -1).otherwise(F.col("label"))
    return rows.select(F.col("id").alias("article_id"), "doc_id", key.cast("int").alias("topic_key"), F.lit(1.0).alias("probability"), F.to_date("published_at").alias("run_date"), F.explode(F.array(F.lit("global"), "source_kind")).alias("portee"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic_key, label, top_words, centroid, active: a row for each embedding label but 0."""
    x = table(spark, sf_dir, "embeddings").filter("label > 0").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = x.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroid = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c"))
    return centroid.select(F.col("label").cast("int").alias("topic_key"), F.expr("'theme ' || label").alias("label"), F.expr("'k' || label || ', k' || (label % 3) || ', k' || (label % 4 + 10) || ', common'").alias("top_words"), F.transform("c", lambda s: s["x"]).alias("centroid"), (F.col("label") != 9).alias("active"))


def topic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry without its centroids."""
    return table(spark, sf_dir, "embeddings").filter("label > 0").select("label").distinct().select(F.col("label").cast("int").alias("topic_key"), F.expr("'theme ' || label").alias("label"), F.expr("'k' || label || ', k' || (label % 3) || ', k' || (label % 4 + 10) || ', common'").alias("top_words"), (F.col("label") != 9).alias("active"))


def supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic_key, run_date, source_kind, n_docs, top_words: a topic's documents of a day by kind."""
    a = assignments(spark, sf_dir).filter("portee <> 'global' AND topic_key >= 0 AND run_date IS NOT NULL")
    return a.groupBy("topic_key", "run_date", F.col("portee").alias("source_kind")).agg(F.count("*").alias("n_docs")).withColumn("top_words", F.expr("'k' || topic_key || ' ' || source_kind"))


def techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir).filter("doc_id % 7 = 0 AND source_kind IN ('tv', 'youtube')")
    return a.select(F.col("id").alias("article_id"), F.expr(_pick(TECHNIQUES, "doc_id % 15")).alias("technique"), F.expr("CAST(doc_id % 11 AS DOUBLE) / 10").alias("confiance"), F.left("content", F.lit(80)).alias("extrait"))


def topic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic_key, coherence, distinction, run_date: two runs of judgements over the registry."""
    runs = F.explode(F.array(F.lit("2024-01-15").cast("date"), F.lit(AS_OF).cast("date")))
    return topic_names(spark, sf_dir).select("topic_key", runs.alias("run_date")).select("topic_key", F.expr("'category ' || topic_key").alias("categorie"), F.expr("CAST((topic_key * 5 + day(run_date)) % 7 AS DOUBLE) / 6").alias("coherence"), F.expr("CAST((topic_key * 3 + day(run_date)) % 7 AS DOUBLE) / 6").alias("distinction"), "run_date")


def _list(names: list[str], i: str) -> str:
    return f"list_extract([{', '.join(repr(n) for n in names)}], CAST({i} AS INTEGER) + 1)"


#: The same tables in the other engine's SQL: A, S, ASG, T, TS, X, Q.
VIEWS = f"""
WITH base AS (SELECT doc_id, text, lang, source, CAST(substr(source, 4) AS BIGINT) AS sn, doc_id // 100 AS pn, (doc_id // 20) % 5 AS q FROM documents),
kinds AS (SELECT *, {_list(KINDS, "sn % 5")} AS source_kind FROM base),
A AS (SELECT left(sha256('doc://' || doc_id), 16) AS id, doc_id, source AS source_name, source_kind, {_list(TYPES, "(sn // 5) % 4")} AS type_media, {_list(LEGAL, "sn % 3")} AS statut_legal_ru,
      CASE source_kind WHEN 'youtube' THEN 'https://example.org/watch?v=v' || sn || '_' || pn || '&t=' || (90 * q) || 's' WHEN 'tv' THEN 'https://example.org/video/x' || sn || 'p' || pn || '/?t=' || (90 * q) ELSE 'https://example.org/a/' || doc_id END AS url,
      left(split_part(text, chr(10), 1), 120) || CASE WHEN source_kind IN ('youtube', 'tv') THEN ' [' || (q + 1) || '/5]' ELSE '' END AS title,
      CASE WHEN doc_id % 41 = 0 THEN NULL ELSE text END AS content, lang AS language, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'Author ' || (doc_id % 23) END AS author,
      CASE WHEN doc_id % 97 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + to_minutes((37 * doc_id) % 43200) END AS published_at,
      CASE WHEN doc_id % 97 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 01:00:00' + to_minutes((37 * doc_id) % 43200) END AS fetched_at,
      CASE WHEN source_kind IN ('youtube', 'tv') THEN (131 * pn + 17 * sn) % 5000 END AS view_count FROM kinds),
S0 AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'anti' WHEN quality = 1 THEN 'pro' WHEN quality = 0 THEN 'neutre' ELSE 'non_concerne' END AS stance, unnest([d.doc_id % 16, (d.doc_id % 16 + 5) % 16]) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
S AS (SELECT left(sha256('doc://' || doc_id), 16) AS article_id, doc_id, {_list(TARGETS, "t")} AS target, stance, CAST(doc_id % 10 AS DOUBLE) / 10 AS score, CAST(CASE stance WHEN 'pro' THEN 0.6 WHEN 'anti' THEN -0.7 WHEN 'neutre' THEN 0.05 ELSE 0.0 END AS DOUBLE) AS lean FROM S0),
ASG AS (SELECT A.id AS article_id, A.doc_id, CASE WHEN e.label = 0 THEN -1 ELSE e.label END AS topic_key, 1.0::DOUBLE AS probability, CAST(A.published_at AS DATE) AS run_date, unnest(['global', A.source_kind]) AS portee FROM A JOIN embeddings e ON A.doc_id = e.vec_id),
T AS (SELECT DISTINCT label AS topic_key, 'theme ' || label AS label, 'k' || label || ', k' || (label % 3) || ', k' || (label % 4 + 10) || ', common' AS top_words, label <> 9 AS active FROM (SELECT label FROM embeddings WHERE label > 0)),
TS AS (SELECT topic_key, run_date, portee AS source_kind, count(*)::BIGINT AS n_docs, any_value('k' || topic_key || ' ' || portee) AS top_words FROM ASG WHERE portee <> 'global' AND topic_key >= 0 AND run_date IS NOT NULL GROUP BY topic_key, run_date, portee),
X AS (SELECT id AS article_id, {_list(TECHNIQUES, "doc_id % 15")} AS technique, CAST(doc_id % 11 AS DOUBLE) / 10 AS confiance, left(content, 80) AS extrait FROM A WHERE doc_id % 7 = 0 AND source_kind IN ('tv', 'youtube')),
Q AS (SELECT topic_key, 'category ' || topic_key AS categorie, CAST((topic_key * 5 + day(run_date)) % 7 AS DOUBLE) / 6 AS coherence, CAST((topic_key * 3 + day(run_date)) % 7 AS DOUBLE) / 6 AS distinction, run_date FROM (SELECT topic_key, unnest([DATE '2024-01-15', DATE '{AS_OF}']) AS run_date FROM T))
"""

PARENT = "CASE WHEN source_kind = 'youtube' THEN regexp_extract(url, 'v=([A-Za-z0-9_-]+)', 1) WHEN source_kind = 'tv' THEN regexp_extract(url, 'video/([A-Za-z0-9]+)', 1) ELSE id END"
WORDS = "(length(content) - length(replace(content, ' ', '')) + 1)"
