"""Sampling weights over a filtered corpus, and what they cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions.columns import block


def _strata(df: DataFrame) -> DataFrame:
    return df.withColumn("__family", F.coalesce("type_media", F.lit("inconnu"))).withColumn("__block", block(F.col("type_media")))


def weighted(df: DataFrame, scheme: str) -> DataFrame:
    """df with w, each row's weight: raw, source, family, block, or family_source (both at once).

    Counts come from an aggregation by source that is joined back (a row for
    each source, with AQE free to broadcast it), not from a window over the rows.
    """
    if scheme == "raw":
        return df.withColumn("w", F.lit(1.0))
    by = {"source": ["source_name"], "family": ["__family"], "block": ["__block"]}
    rows = _strata(df)
    if scheme in by:
        keys = by[scheme]
        counts = rows.groupBy(*keys).agg((1.0 / F.count("*").cast("double")).alias("w"))
    else:
        keys = ["source_name", "__family"]
        per_source = rows.groupBy("source_name").agg(F.count("*").alias("n"))
        per_family = rows.groupBy("__family").agg(F.countDistinct("source_name").alias("m"))
        counts = rows.select(*keys).distinct().join(per_source, "source_name").join(per_family, "__family").select(*keys, (1.0 / (F.col("n") * F.col("m")).cast("double")).alias("w"))
    return rows.join(counts, keys).drop("__family", "__block").select(*df.columns, "w")


def kish(w: str = "w"):
    """Effective sample size: (sum w)^2 / sum w^2; 0 without rows."""
    return F.coalesce(F.pow(F.sum(w), 2) / F.nullif(F.sum(F.col(w) * F.col(w)), F.lit(0.0)), F.lit(0.0))


def denominators(df: DataFrame) -> DataFrame:
    """sum_w, sum_w_chars, n_eff of weighted rows."""
    return df.agg(F.round(F.sum("w"), 6).alias("sum_w"), F.round(F.sum(F.col("w") * F.length("content")), 4).alias("sum_w_chars"), F.round(kish(), 6).alias("n_eff"))


def composition(df: DataFrame, stratum) -> DataFrame:
    """strate, docs, sources, part, fragile: what each stratum weighs, and whether that rests on few sources or documents."""
    rows = df.withColumn("strate", stratum).groupBy("strate").agg(F.count("*").alias("docs"), F.countDistinct("source_name").alias("sources"), F.sum("w").alias("sw"))
    total = rows.agg(F.sum("sw").alias("all_w"))
    part = F.round(100.0 * F.col("sw") / F.nullif("all_w", F.lit(0.0)), 6)
    out = rows.crossJoin(F.broadcast(total)).select("strate", "docs", "sources", part.alias("part"))
    return out.withColumn("fragile", (F.col("part") >= 10) & ((F.col("sources") < 3) | (F.col("docs") < 200)))


def weighted_topics(df: DataFrame, assigned: DataFrame, topics: DataFrame, axis) -> DataFrame:
    """topic_key, label, decoupe, n, chars: weighted documents and characters by topic and axis."""
    rows = df.withColumn("decoupe", axis).join(assigned, df["id"] == assigned["article_id"]).join(topics, "topic_key")
    return rows.groupBy("topic_key", "label", "decoupe").agg(F.round(F.sum("w"), 6).alias("n"), F.round(F.sum(F.col("w") * F.length("content")), 4).alias("chars"))
