"""Schemas of the tables that the engine keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLES_DDL = (
    "id string, source_name string, feed_url string, url string, title string, author string, summary string, content string, language string, "
    "published_at timestamp, fetched_at timestamp, raw_html string, pays string, type_media string, statut_legal_ru string, source_kind string, view_count bigint"
)
SENTIMENT_DDL = "article_id string, target string, stance string, score double, lean double, reasoning string, method string, created_at timestamp"
TOPICS_DDL = "topic_key int, label string, top_words string, centroid array<double>, article_count bigint, first_seen date, last_seen date, active boolean, portee string"
ASSIGNMENTS_DDL = "article_id string, topic_key int, probability double, run_date date, portee string"
SUPPORTS_DDL = "topic_key int, run_date date, source_kind string, n_docs bigint, top_words string"
DIVERGENCE_DDL = "axe string, groupe string, token string, contribution double, freq_groupe double, freq_reste double, n_groupe bigint, rang int, run_date date"
TECHNIQUES_DDL = "article_id string, technique string, confiance double, extrait string, run_date date"
QUALITY_DDL = "topic_key int, categorie string, coherence double, distinction double, n_test int, n_controle int, run_date date"

#: Columns that old data may lack, and what they hold then.
DEFAULTS = {"source_kind": "press"}


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the columns of ddl: cast, in order, those missing filled with their default or null."""
    out = []
    for f in T.StructType.fromDDL(ddl).fields:
        value = F.col(f.name) if f.name in df.columns else F.lit(DEFAULTS.get(f.name))
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(out)


def table_or_empty(spark: SparkSession, name: str, ddl: str) -> DataFrame:
    """A catalogue table, or no rows of its schema where it doesn't exist (enrichment tables are optional)."""
    return conform(spark.table(name), ddl) if spark.catalog.tableExists(name) else spark.createDataFrame([], ddl)
