"""Volumes, units, rankings and coverage of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions.columns import long_enough, offset_seconds, parent_id, period, share, word_count


def parent() -> Column:
    """The unit that a row of articles belongs to."""
    return parent_id(F.col("source_kind"), F.col("url"), F.col("id"))


def header(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.countDistinct("source_name").alias("n_src"), F.date_format(F.max("fetched_at"), "yyyy-MM-dd HH:mm").alias("last_fetched"))


def natural_units(df: DataFrame) -> DataFrame:
    return df.groupBy("source_kind").agg(F.countDistinct(parent()).alias("n"))


def volumes(df: DataFrame, *keys: str) -> DataFrame:
    """Units, segments, words, sources, seconds and views by keys, in one pass by parent and one by key.

    A parent's views and length are repeated on its segments: the largest counts,
    once. Rows first shrink to their parents, which also keeps a key with most
    of the rows from making one large group.
    """
    by = df.withColumn("parent", parent()).groupBy(*keys, "parent").agg(
        F.count("*").alias("segments"), F.sum(word_count(F.col("content"))).alias("mots"), F.max("view_count").alias("vues"), F.max(offset_seconds(F.col("url"))).alias("secondes"), F.collect_set("source_name").alias("names"), F.max("published_at").alias("last")
    )
    n = by.groupBy(*keys).agg(F.count("parent").alias("unites"), F.sum("segments").alias("segments"), F.sum("mots").alias("mots"), F.size(F.array_distinct(F.flatten(F.collect_set("names")))).cast("long").alias("sources"), F.sum("secondes").cast("long").alias("secondes"), F.sum("vues").cast("long").alias("vues"), F.max("last").alias("last"))
    return n


def top_sources_over_time(df: DataFrame, grain: str, most: int = 5) -> DataFrame:
    """jour, display, n: the largest sources by name, the others together."""
    by = df.filter("published_at IS NOT NULL").groupBy(period(F.col("published_at"), grain).alias("jour"), "source_name").agg(F.count("*").alias("n"))
    rank = by.groupBy("source_name").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "source_name").limit(most).select("source_name", F.col("source_name").alias("display"))
    return by.join(F.broadcast(rank), "source_name", "left").groupBy("jour", F.coalesce("display", F.lit("others")).alias("display")).agg(F.sum("n").alias("n"))


def authors(df: DataFrame, least: int = 1) -> DataFrame:
    """source_name, auteur, n."""
    named = df.filter(F.coalesce(F.trim("author"), F.lit("")) != "")
    return named.groupBy("source_name", F.trim("author").alias("auteur")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def hierarchy(by: DataFrame, sources: int = 15, per_source: int = 10) -> DataFrame:
    """source_name, auteur, n, pct: each large source's first authors, as shares of all."""
    total = by.agg(F.sum("n").alias("all_n"))
    large = by.groupBy("source_name").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "source_name").limit(sources).select("source_name")
    rank = F.row_number().over(Window.partitionBy("source_name").orderBy(F.desc("n"), "auteur"))
    top = by.join(F.broadcast(large), "source_name").withColumn("r", rank).filter(F.col("r") <= per_source)
    return top.crossJoin(F.broadcast(total)).select("source_name", "auteur", "n", share(F.col("n"), F.col("all_n")).alias("pct"))


def ranked(df: DataFrame, keys: list[str], most: int, value: str = "n") -> DataFrame:
    return df.orderBy(F.desc(value), *keys).limit(most)


def processed(df: DataFrame, key: Column | str, sentiment: DataFrame, assigned: DataFrame) -> DataFrame:
    """key, total, contenu, auteur, sentiment, themes: rows, how many hold text enough to be analysed, and how many each step has reached.

    The steps' ids are made distinct and joined to the rows once, then one
    aggregation counts all of them.
    """
    s = sentiment.select(F.col("article_id").alias("id"), F.lit(1).alias("__s")).distinct()
    t = assigned.select(F.col("article_id").alias("id"), F.lit(1).alias("__t")).distinct()
    rows = df.join(s, "id", "left").join(t, "id", "left")
    return rows.groupBy(key).agg(F.count("*").alias("total"), F.count_if(long_enough(F.col("content"), F.col("source_kind"))).alias("contenu"), F.count_if(F.trim("author") != "").alias("auteur"), F.count("__s").alias("sentiment"), F.count("__t").alias("themes"))


def _reached(n: DataFrame, digits: int) -> dict[str, Column]:
    """Shares of processed's counts: of all rows, or of those long enough for the analyses (null where there are none)."""
    pct = lambda c, of: F.round(100 * F.col(c) / F.nullif(F.col(of), F.lit(0)), digits)
    return {"contenu": pct("contenu", "total"), "auteur": pct("auteur", "total"), "sentiment": pct("sentiment", "contenu"), "themes": pct("themes", "contenu")}


def coverage(df: DataFrame, sentiment: DataFrame, assigned: DataFrame, good: int = 95, fair: int = 80) -> DataFrame:
    """source, articles, whole percentages of each step, the least of the analyses, status."""
    n = processed(df, F.col("source_name").alias("source"), sentiment, assigned)
    out = n.select("source", F.col("total").alias("articles"), *[c.cast("int").alias(k) for k, c in _reached(n, 0).items()])
    out = out.withColumn("analyses", F.least("sentiment", "themes"))
    below = lambda limit: (F.col("contenu") < limit) | (F.col("analyses") < limit)
    return out.withColumn("statut", F.when(below(fair), "PROBLÈME").when(below(good), "ATTENTION").otherwise("OK"))


def coverage_over_time(df: DataFrame, sentiment: DataFrame, assigned: DataFrame, grain: str = "week") -> DataFrame:
    """period, total, contenu, sentiment, themes: percentages by period, to one digit."""
    n = processed(df, period(F.col("published_at"), grain).alias("period"), sentiment, assigned)
    return n.select("period", "total", *[c.alias(k) for k, c in _reached(n, 1).items() if k != "auteur"])


def overview(df: DataFrame, as_of: str) -> DataFrame:
    """By source: articles, videos, first and last day, last seven days, authors, languages."""
    recent = F.col("published_at") >= F.date_sub(F.lit(as_of).cast("date"), 7).cast("timestamp")
    video = F.when(F.col("source_kind").isin("youtube", "tv"), parent())
    return df.groupBy(F.col("source_name").alias("source"), "type_media").agg(
        F.count("*").alias("articles"), F.countDistinct(video).alias("videos"), F.date_format(F.min("published_at"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("published_at"), "yyyy-MM-dd").alias("last"), F.count_if(recent).alias("recent_7d"), F.countDistinct("author").alias("authors"), F.countDistinct("language").alias("languages")
    )


def collection_runs(times: DataFrame, column: str, gap: str = "30 minutes") -> DataFrame:
    """start, end, n: runs of a time column with no gap over the given one.

    Session windows make a day's runs, each day by itself. A day's first run goes
    on with the run before it if their gap is short enough; that is found from a
    row for each day, the only rows that meet in one task.
    """
    t = times.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("timestamp").alias("t")).agg(F.count("*").alias("n"))
    runs = t.groupBy(F.to_date("t").alias("day"), F.session_window("t", gap).alias("s")).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.sum("n").alias("n"))
    days = runs.groupBy("day").agg(F.min("start").alias("first"), F.max("end").alias("last"), F.count("*").alias("runs"))
    by_day = Window.orderBy("day")
    joined = F.coalesce(F.col("first") < F.lag("last").over(by_day) + F.expr(f"INTERVAL {gap}"), F.lit(False)).cast("int")
    days = days.withColumn("joined", joined).withColumn("before", F.coalesce(F.sum(F.col("runs") - F.col("joined")).over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.col("before") + F.row_number().over(Window.partitionBy("day").orderBy("start")) - F.col("joined")
    numbered = runs.join(days.select("day", "joined", "before"), "day").withColumn("run", number)
    return numbered.groupBy("run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("run")


def treemap(by: DataFrame, group: str, member: str, groups: int = 15, most: int = 10) -> DataFrame:
    """group, member, n, pct of all rows: of the largest groups the largest members each (ties: first by name)."""
    sizes = by.groupBy(group).agg(F.sum("n").alias("size"))
    top = sizes.orderBy(F.desc("size"), group).limit(groups).select(group)
    total = by.agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), member))
    rows = by.join(F.broadcast(top), group).withColumn("r", rank).filter(F.col("r") <= most)
    return rows.crossJoin(F.broadcast(total)).select(group, member, "n", share(F.col("n"), F.col("total"), 2).alias("pct"))
