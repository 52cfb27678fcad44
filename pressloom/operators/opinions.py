"""Stance and lean toward targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions.columns import period, share


def weighted_lean() -> Column:
    """Scores weigh leans; without any score there is no weighted mean."""
    return F.sum(F.col("lean") * F.col("score")) / F.nullif(F.sum("score"), F.lit(0.0))


def concerned() -> Column:
    return F.col("stance") != "non_concerne"


def on_articles(sentiment: DataFrame, articles: DataFrame) -> DataFrame:
    return sentiment.select("article_id", "target", "stance", "score", "lean").join(articles, F.col("article_id") == F.col("id"))


def distribution(rows: DataFrame, target: str, only: bool = False) -> DataFrame:
    rows = rows.filter(F.col("target") == target)
    return (rows.filter(concerned()) if only else rows).groupBy("stance").agg(F.count("*").alias("n"))


def balance(rows: DataFrame, target: str, edge: float = 0.2) -> DataFrame:
    """Mean lean (plain where no score weighs) and how many lean each way."""
    r = rows.filter((F.col("target") == target) & concerned())
    return r.agg(F.round(F.coalesce(weighted_lean(), F.avg("lean")), 6).alias("avg_lean"), F.count_if(F.col("lean") < -edge).alias("anti_count"), F.count_if(F.col("lean").between(-edge, edge)).alias("neutre_count"), F.count_if(F.col("lean") > edge).alias("pro_count"), F.count("*").alias("total"))


def over_time(rows: DataFrame, target: str, grain: str) -> tuple[DataFrame, DataFrame]:
    """Stances by period; weighted lean by period (null without scores)."""
    r = rows.filter((F.col("target") == target) & concerned() & F.col("published_at").isNotNull()).withColumn("periode", period(F.col("published_at"), grain))
    return r.groupBy("periode", "stance").agg(F.count("*").alias("n")), r.groupBy("periode").agg(F.round(weighted_lean(), 6).alias("lean_avg"), F.count("*").alias("n"))


def by_source(rows: DataFrame, target: str) -> DataFrame:
    """source_name, pro, neutre, anti as shares of the concerned."""
    r = rows.filter((F.col("target") == target) & concerned()).groupBy("source_name").pivot("stance", ["pro", "neutre", "anti"]).agg(F.count(F.lit(1)))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = z("pro") + z("neutre") + z("anti")
    return r.select("source_name", *[share(z(c), total).alias(c) for c in ("pro", "neutre", "anti")])


def influence(rows: DataFrame) -> DataFrame:
    """target, pro, anti, mentions, lean_avg."""
    return rows.filter(concerned()).groupBy("target").agg(F.count_if(F.col("stance") == "pro").alias("pro"), F.count_if(F.col("stance") == "anti").alias("anti"), F.count("*").alias("mentions"), F.round(weighted_lean(), 6).alias("lean_avg"))


def extremes(table: DataFrame) -> DataFrame:
    """The scale's half width (0.1 at least) and the target farthest from 0."""
    far = F.abs(F.coalesce("lean_avg", F.lit(0.0)))
    return table.agg(F.greatest(F.max(far), F.lit(0.1)).alias("amplitude"), F.max_by("target", F.struct(far, "target")).alias("extreme"))


def source_ranking(rows: DataFrame, target: str, mode: str, least: int = 3, most: int = 25) -> DataFrame:
    """Sources by share pro, share anti, or lean toward a target, of those with enough concerned documents."""
    r = rows.filter((F.col("target") == target) & concerned()).groupBy("source_name").agg(F.count("*").alias("concerne"), F.count_if(F.col("stance") == "pro").alias("pro"), F.count_if(F.col("stance") == "anti").alias("anti"), F.round(weighted_lean(), 6).alias("lean_avg")).filter(F.col("concerne") >= least)
    value = {"pro": share(F.col("pro"), F.col("concerne")), "anti": share(F.col("anti"), F.col("concerne")), "lean": F.col("lean_avg")}[mode]
    return r.withColumn("value", value).orderBy(F.col("value").desc_nulls_last(), "source_name").limit(most)


def author_ranking(rows: DataFrame, target: str, least: int = 3, most: int = 40) -> DataFrame:
    r = rows.filter((F.col("target") == target) & concerned() & (F.coalesce(F.trim("author"), F.lit("")) != ""))
    n = lambda s: F.count_if(F.col("stance") == s).alias(s)
    r = r.groupBy(F.trim("author").alias("auteur"), "source_name").agg(F.countDistinct("article_id").alias("articles_concernes"), F.round(weighted_lean(), 3).alias("lean_moyen"), n("pro"), n("anti"), n("neutre")).filter(F.col("articles_concernes") >= least)
    return r.orderBy(F.desc("articles_concernes"), "auteur", "source_name").limit(most)


def strongest(rows: DataFrame, target: str, most: int = 15) -> DataFrame:
    """The best scored documents of each stance."""
    r = rows.filter((F.col("target") == target) & concerned())
    rank = F.row_number().over(Window.partitionBy("stance").orderBy(F.desc("score"), "article_id"))
    return r.withColumn("rank", rank).filter(F.col("rank") <= most)


def latest_wins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key, the last by order (an upsert without a merge)."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")
