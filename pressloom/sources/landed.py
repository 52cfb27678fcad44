"""Readers of landed material: feeds, pages, captions, catalogues, stored tables. Collection itself is outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions.columns import first_line, iso_time, relative_date, url_hash
from pressloom.functions.segments import clean_cues

# The kind of a source by its collector.
KIND_OF = {"rss": "press", "scrape": "press", "telegram": "telegram", "youtube": "youtube", "rutube": "tv", "hls": "tv", "vk": "vk"}


def feed(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """id, url, title, author, summary, published_at of a feed's entries; those without a link are left out."""
    schema = "title string, link string, author string, description string, pubDate string, published string, updated string, summary string"
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    when = F.coalesce(*[iso_time(F.col(c)) for c in ("published", "pubDate", "updated")])
    rows = rows.filter(F.length(F.trim("link")) > 0)
    return rows.select(url_hash(F.trim("link")).alias("id"), F.trim("link").alias("url"), F.trim("title").alias("title"), "author", F.coalesce("summary", "description").alias("summary"), when.alias("published_at"))


def captions(spark: SparkSession, path: str) -> DataFrame:
    """video, cues of caption files (JSON a line: video, events with tStartMs and segs)."""
    rows = spark.read.schema("video string, events array<struct<tStartMs: double, segs: array<struct<utf8: string>>>>").json(path)
    rows = rows.select("video", F.posexplode("events").alias("pos", "e")).filter(F.size("e.segs") > 0)
    rows = rows.select("video", "pos", (F.coalesce("e.tStartMs", F.lit(0.0)) / 1000).alias("t"), F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), "").alias("text"))
    return cues_of(clean_cues(rows))


def cues_of(rows: DataFrame) -> DataFrame:
    """video, cues: a video's cues in order. A video is a bounded group."""
    return rows.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("pos", "t", "text"))).alias("c")).select("video", F.transform("c", lambda x: F.struct(x["t"].alias("t"), x["text"].alias("text"))).alias("cues"))


def episodes(found: DataFrame, author_id: Column, pattern: Column, as_of: str, *, seconds: tuple[int, int] = (180, 14400), days: int = 21, most: int = 2, seen: DataFrame | None = None) -> DataFrame:
    """Of a programme's search results the newest, by its own account, titled as it is, of its length, recent, not yet stored."""
    rows = found.filter((F.col("author_id") == author_id) & F.regexp_like("title", pattern) & F.col("duration").between(*seconds) & (F.col("published_at") >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")))
    rows = rows.join(seen.select("video"), "video", "left_anti") if seen is not None else rows
    rank = F.row_number().over(Window.partitionBy("source_name").orderBy(F.desc("published_at"), "video"))
    return rows.withColumn("__r", rank).filter(F.col("__r") <= most).drop("__r")


def wall_posts(posts: DataFrame, now: str, least: int = 80) -> DataFrame:
    """Posts of a wall (source_name, url, text, label): title, time from its relative label."""
    rows = posts.filter(F.length("text") >= least)
    return rows.select(url_hash(F.col("url")).alias("id"), "source_name", "url", first_line(F.col("text")).alias("title"), F.col("text").alias("content"), relative_date(F.col("label"), F.lit(now).cast("timestamp")).alias("published_at"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The source catalogue, a YAML list of a few dozen entries, with each source's kind."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    entries = yaml.safe_load(text)
    entries = entries["sources"] if isinstance(entries, dict) else entries
    fields = ["name", "url", "type", "media_type", "legal_status", "historical_stance", "status"]
    rows = [tuple(None if e.get(f) is None else str(e.get(f)) for f in fields) for e in entries]
    df = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv]), F.col("type"))
    return df.withColumn("source_kind", kind)


def landed(rows: DataFrame) -> DataFrame:
    """Raw rows to articles' ids: rows without an address are dropped, the first of each id stays."""
    return rows.filter(F.length("url") > 0).withColumn("id", url_hash(F.col("url"))).dropDuplicates(["id"])
