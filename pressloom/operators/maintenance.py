"""Changes to stored tables: idempotent inserts, upserts, partition overwrites, cascades, repairs.

Parquet tables have neither MERGE nor DELETE. A change is a new state written
beside the old one and then put in its place, never over a path being read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions.columns import bad_author
from pressloom.functions.html import page_author, page_date


def insert_new(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("id", "url")) -> DataFrame:
    """The rows of new to append: none of their keys is stored, and each occurs once among them."""
    out = new
    for k in keys:
        out = out.join(stored.select(k).distinct(), k, "left_anti").dropDuplicates([k])
    return out.select(new.columns)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of new in place of those with their keys."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace only the partitions that df has rows for (delete and insert by run)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def swap(spark: SparkSession, df: DataFrame, name: str) -> None:
    """Put df in the place of a catalogue table that it may be computed from."""
    fresh = f"{name}_{uuid.uuid4().hex[:8]}"
    df.write.format("parquet").saveAsTable(fresh)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name.split('.')[-1]}")


def without(rows: DataFrame, gone: DataFrame, key: str, of: str = "id") -> DataFrame:
    return rows.join(gone.select(F.col(of).alias(key)).distinct(), key, "left_anti").select(rows.columns)


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table (rows, its key to the article) without the rows of the articles gone; absent tables are simply not passed."""
    return {name: without(rows, gone, key) for name, (rows, key) in tables.items()}


def repaired(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns filled where null; what is there stays."""
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in columns.items()})


def late_dates(stored: DataFrame, pages: DataFrame, key: str = "id") -> DataFrame:
    """stored (key, published_at, fetched_at) with dates that were missing, and the way each was found (method).

    Only pages (key, url, html; one a key) of rows without a date are parsed. A row
    whose page is gone or holds no date takes the time it was fetched at; without
    that it stays null, with a null method.
    """
    found_as = "found"
    while found_as in {c.lower() for c in stored.columns}:
        found_as = f"_{found_as}"
    missing = stored.filter("published_at IS NULL").select(key)
    found = pages.join(missing, key, "left_semi").dropDuplicates([key]).select(key, page_date(F.col("html"), F.col("url")).alias(found_as))
    kept, found_at = F.col("published_at").isNotNull(), F.col(f"{found_as}.dt").isNotNull()
    rows = stored.join(found, key, "left").withColumn("method", F.when(kept, "kept").when(found_at, F.col(f"{found_as}.method")).when(F.col("fetched_at").isNotNull(), "fetched"))
    return repaired(rows, published_at=F.coalesce(f"{found_as}.dt", "fetched_at")).drop(found_as)


def audited_authors(stored: DataFrame, pages: DataFrame, key: str = "id") -> DataFrame:
    """stored (key, author, source_name) with bad authors taken out and missing ones found on their pages, and what became of each (outcome).

    outcome: kept; nulled (bad, nothing found); replaced (bad, found on the page);
    found (none before); missing. Only pages (key, html; one a key) of rows without
    a good author are parsed, once. What is found is cleaned; what is kept stays as
    it is. A blank author counts as none and becomes null.
    """
    taken = {c.lower() for c in stored.columns}
    free = lambda n: n if n not in taken else free(f"_{n}")
    found, good, page, of = map(free, ("found", "good", "page", "of"))
    blank = F.coalesce(F.trim("author"), F.lit("")) == ""
    rows = stored.withColumn(good, ~blank & ~F.coalesce(bad_author(F.col("author"), F.col("source_name")), F.lit(False)))
    asked = rows.filter(~F.col(good)).groupBy(key).agg(F.min("source_name").alias(of))
    held = pages.select(key, F.col("html").alias(page)).join(asked, key).dropDuplicates([key])
    names = held.select(key, page_author(F.col(page), F.coalesce(of, F.lit(""))).alias(found))
    out = rows.join(names, key, "left")
    there = F.col(found).isNotNull()
    outcome = F.when(F.col(good), "kept").when(blank, F.when(there, "found").otherwise("missing")).otherwise(F.when(there, "replaced").otherwise("nulled"))
    out = out.withColumn("outcome", outcome).withColumn("author", F.when(F.col(good), F.col("author")).otherwise(F.col(found)))
    return out.select(*stored.columns, "outcome")


def with_default(df: DataFrame, column: str, value: str) -> DataFrame:
    """A column that older rows lack, or hold null in, filled with the value (scopes came later than assignments)."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in df.columns else F.lit(value))


def drop_derived(spark: SparkSession, names: list[str], base: tuple[str, ...] = ("articles", "sources")) -> list[str]:
    """Drop the tables that can be computed again; those whose last part is a base table's name stay, and are returned."""
    kept = [n for n in names if n.split(".")[-1].rpartition("__")[2] in base]
    for n in names:
        if n not in kept:
            spark.sql(f"DROP TABLE IF EXISTS {n}")
    return kept


def refreshed_counts(topics: DataFrame, assigned: DataFrame) -> DataFrame:
    n = assigned.groupBy("topic_key").agg(F.count("*").alias("article_count"))
    return topics.drop("article_count").join(n, "topic_key", "left").withColumn("article_count", F.coalesce("article_count", F.lit(0)))


def live_only(quality: DataFrame, topics: DataFrame) -> DataFrame:
    """Without rows of topics that no longer exist."""
    return quality.join(topics.select("topic_key"), "topic_key", "left_semi")


def numbered(df: DataFrame, start: int, key: str, order: str) -> DataFrame:
    """New keys from start on, in order, for a few rows (a sequence's work)."""
    from pyspark.sql import Window

    return df.withColumn(key, (F.lit(start) + F.row_number().over(Window.orderBy(order))).cast("int"))
