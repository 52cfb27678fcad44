"""Two adjacent windows of days, compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions.columns import share


def window_flag(ts: Column, as_of: str, days: int) -> Column:
    """recent: the last days up to as_of; prior: as many before; null beyond."""
    end = F.date_add(F.lit(as_of).cast("date"), 1)
    at = lambda n: F.date_sub(end, n).cast("timestamp")
    return F.when((ts >= at(days)) & (ts < at(0)), "recent").when((ts >= at(2 * days)) & (ts < at(days)), "prior")


def compare_periods(df: DataFrame, ts: str, as_of: str, days: int, keys: list[str], **aggs: Column) -> DataFrame:
    """keys, and <agg>_recent, <agg>_prior for each aggregate: one scan, one row for each key."""
    rows = df.withColumn("__w", window_flag(F.col(ts), as_of, days)).filter("__w IS NOT NULL")
    out = rows.groupBy(*keys).pivot("__w", ["recent", "prior"]).agg(*[a.alias(n) for n, a in aggs.items()])
    if len(aggs) == 1:  # the pivot then leaves the aggregate's name out
        name = next(iter(aggs))
        out = out.withColumnRenamed("recent", f"recent_{name}").withColumnRenamed("prior", f"prior_{name}")
    return out.select(*keys, *[F.col(f"{w}_{n}").alias(f"{n}_{w}") for n in aggs for w in ("recent", "prior")])


def volume_change(df: DataFrame, as_of: str, days: int, least: int = 100, low: float = 0.67, high: float = 1.5) -> DataFrame:
    """n_recent, n_ref, ratio, comparable (enough documents on both sides and no jump in volume)."""
    w = window_flag(F.col("published_at"), as_of, days)
    n = df.agg(F.count_if(w == "recent").alias("n_recent"), F.count_if(w == "prior").alias("n_ref"))
    ratio = F.round(F.col("n_recent") / F.nullif(F.col("n_ref").cast("double"), F.lit(0.0)), 6)
    return n.withColumn("ratio", ratio).withColumn("comparable", F.coalesce((F.col("n_recent") >= least) & (F.col("n_ref") >= least) & F.col("ratio").between(low, high), F.lit(False)))


def lean_drift(rows: DataFrame, as_of: str, days: int, least: int = 10, most: int = 8) -> DataFrame:
    """target, lean_prior, lean_recent, delta, n_prior, n_recent: targets whose lean moved most."""
    mean = F.sum(F.col("lean") * F.col("score")) / F.nullif(F.sum("score"), F.lit(0.0))
    by = compare_periods(rows.filter("stance <> 'non_concerne'"), "published_at", as_of, days, ["target"], lean=mean, n=F.count(F.lit(1)))
    by = by.filter((F.col("n_recent") >= least) & (F.col("n_prior") >= least)).withColumn("delta", F.round(F.col("lean_recent") - F.col("lean_prior"), 6))
    return by.select("target", F.round("lean_prior", 6).alias("lean_prior"), F.round("lean_recent", 6).alias("lean_recent"), "delta", "n_prior", "n_recent").orderBy(F.abs("delta").desc(), "target").limit(most)


def share_drift(rows: DataFrame, label: str, as_of: str, days: int, most: int = 10) -> DataFrame:
    """label, recent, prior, delta in points of share; what one side lacks counts as 0."""
    n = compare_periods(rows, "published_at", as_of, days, [label], n=F.count(F.lit(1))).select(label, F.coalesce("n_recent", F.lit(0)).alias("r"), F.coalesce("n_prior", F.lit(0)).alias("p"))
    total = n.agg(F.sum("r").alias("tr"), F.sum("p").alias("tp"))
    z = lambda c, t: F.coalesce(share(F.col(c), F.col(t)), F.lit(0.0))
    out = n.crossJoin(F.broadcast(total)).select(label, z("r", "tr").alias("recent"), z("p", "tp").alias("prior"))
    return out.withColumn("delta", F.round(F.col("recent") - F.col("prior"), 4)).orderBy(F.abs("delta").desc(), label).limit(most)
