"""Writers: append what is new, export a snapshot, keep verdicts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a snapshot: all but the raw page.
SNAPSHOT = ["id", "source_name", "feed_url", "url", "title", "author", "summary", "content", "language", "published_at", "fetched_at", "pays", "type_media", "statut_legal_ru", "source_kind", "view_count"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="pressloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written and read back, for what several later steps read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_articles(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Append rows whose id and url aren't stored yet. Partitioned by day, so that date filters prune."""
    from pressloom.sources.keyed import KeyedStore

    KeyedStore(spark, path).append(new)


def exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def export_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Every table that is there, gzip; articles without raw pages."""
    for name, df in tables.items():
        rows = df.select([c for c in SNAPSHOT if c in df.columns]) if name == "articles" else df
        rows.write.mode("overwrite").option("compression", "gzip").parquet(f"{path}/{name}")


def verdicts(spark: SparkSession, cache: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the cache knows of the asked videos, and what it has still to learn."""
    return asked.join(cache, "video"), asked.join(cache.select("video"), "video", "left_anti")
