"""Incremental ingestion: deduplicated rows, windows, sessions, the topic registry across runs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pressloom.operators import topics
from pressloom.operators.maintenance import overwrite_partitions
from pressloom.sources.keyed import KeyedStore

#: Days of a scope that one task takes.
DAYS = 10
_CLUSTER_SCHEMA = "i int, centroid array<double>, label string, top_words string, n long"


def events(spark: SparkSession, path: str, schema: StructType | str, ts: str = "ts") -> DataFrame:
    """A stream of Parquet rows; its time is cast, since watermarks refuse times without zone."""
    return spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def deduplicated(stream: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, ts: str = "ts", late: str = "1 day", size: str = "1 day", *keys: str) -> DataFrame:
    """Counts by day; rows up to `late` behind still count (yesterday's repairs)."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sliding(stream: DataFrame, ts: str = "ts", late: str = "1 day", size: str = "7 days", step: str = "1 day", *keys: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "1 day", *keys: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def drain(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what has arrived through `each` batch, then stop."""
    return df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_articles(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that appends only ids that aren't stored; a batch that is run again adds nothing."""

    def each(batch: DataFrame, number: int) -> None:
        KeyedStore(batch.sparkSession, path, ("id",), day=None).append(batch)

    return each


def into_windows(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer for closed windows, a partition a batch: a batch that is run again takes its own place.

    With a watermark, a stream in append mode emits each window once, when no row
    that still counts can fall in it; its state goes then. Rows that come later
    than that are left out.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return each


def _evolved(threshold: float, keep_label: float, dormant_days: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """One scope's snapshots, day after day, from the last one before and the days' clusters (the rules of topics.greedy_match and topics.update_registry)."""

    def words(text: str | None) -> set[str]:
        return {w.strip() for w in (text or "").split(",")[:10]} - {""}

    def run(key: tuple, before: pd.DataFrame, clusters: pd.DataFrame) -> pd.DataFrame:
        known = {r["topic_key"]: dict(r) for r in before.to_dict("records")}
        out = []
        for day, rows in clusters.groupby("run_date", sort=True):
            rows = rows.sort_values("i").to_dict("records")
            unit = lambda v: np.asarray(v, float) / (np.linalg.norm(np.asarray(v, float)) + 1e-9)
            keys = [k for k, t in known.items() if t["centroid"] is not None and len(t["centroid"])]
            old = np.array([unit(known[k]["centroid"]) for k in keys])
            pairs = [(-float(x), r["i"], k, r) for r in rows for k, x in zip(keys, old @ unit(r["centroid"]) if keys else (), strict=True) if x >= threshold]
            matched: dict[int, int] = {}
            for _, i, k, r in sorted(pairs, key=lambda p: p[:3]):
                if i not in matched and k not in matched.values():
                    matched[i] = k
                    t, a, b = known[k], words(known[k]["top_words"]), words(r["top_words"])
                    same = len(a & b) / len(a | b) if a and b else 0.0
                    t |= {"top_words": r["top_words"], "centroid": r["centroid"], "last_seen": day, "article_count": (t["article_count"] or 0) + r["n"]} | ({} if same >= keep_label else {"label": r["label"]})
            top = max(known, default=0)
            for r in rows:
                if r["i"] not in matched:
                    top += 1
                    known[top] = {"topic_key": top, "label": r["label"], "top_words": r["top_words"], "centroid": r["centroid"], "article_count": r["n"], "first_seen": day, "last_seen": day}
            out += [t | {"active": (day - t["last_seen"]).days <= dormant_days, "portee": key[0], "run_date": day} for t in known.values()]
        return pd.DataFrame(out, columns=[*(f.split()[0] for f in topics.REGISTRY.split(", ")), "run_date"])

    return run


def into_registry(path: str, scope: str | None = None, threshold: float = 0.62, keep_label: float = 0.4, dormant_days: int = 7) -> Callable[[DataFrame, int], None]:
    """A batch writer: clusters (run_date, scope, i, centroid, label, top_words, n) into the registry's snapshots at path, by portee and run_date.

    Scopes are registries of their own, with keys of their own. A batch brings a
    scope's clusters of a day whole; they are kept beside the snapshots, in place
    of what that scope and day had. Every day of the scope from the earliest one
    of the batch on is then made again, from the snapshot before it: a day that
    is run again counts once, and one that arrives late counts on all later days.
    Scopes run side by side; days of one scope follow each other, DAYS at a time
    in one task, which holds the scope's registry and those days' clusters. With
    `scope`, other scopes' rows are left alone.
    """
    from pressloom.sources.sinks import exists, settled

    stored = f"{path.rstrip('/')}.clusters"

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if scope is None else batch.filter(F.col("scope") == scope)
        rows = settled(rows.select(F.col("run_date").cast("date").alias("run_date"), F.col("scope").alias("portee"), "i", "centroid", "label", "top_words", F.col("n").cast("long").alias("n")), "clusters")
        first = {r["portee"]: r["day"] for r in rows.groupBy("portee").agg(F.min("run_date").alias("day")).collect()}  # scopes: a few
        if not first:
            return
        overwrite_partitions(rows, stored, "portee", "run_date")
        made = spark.read.schema(f"{_CLUSTER_SCHEMA}, portee string, run_date date").parquet(stored)
        again = F.lit(False)
        for name, day in first.items():
            again |= (F.col("portee") == name) & (F.col("run_date") >= F.lit(day))
        days: dict[str, list] = {}
        for name, day in made.filter(again).select("portee", "run_date").distinct().orderBy("run_date").collect():  # a row for each day
            days.setdefault(name, []).append(day)
        for at in range(0, max(map(len, days.values())), DAYS):
            spans = [(name, d[at], d[min(at + DAYS, len(d)) - 1]) for name, d in days.items() if at < len(d)]
            span = spark.createDataFrame(spans, "portee string, low date, high date")
            before = spark.createDataFrame([], f"{topics.REGISTRY}, run_date date")
            if exists(spark, path):
                earlier = spark.read.schema(before.schema).parquet(path).join(F.broadcast(span), "portee").filter("run_date < low")
                last = earlier.groupBy("portee").agg(F.max("run_date").alias("run_date"))
                before = earlier.join(F.broadcast(last), ["portee", "run_date"]).select(before.columns)
            now = made.join(F.broadcast(span), "portee").filter("run_date BETWEEN low AND high").select(made.columns)
            out = before.drop("run_date").groupBy("portee").cogroup(now.groupBy(F.col("portee").alias("scope"))).applyInPandas(_evolved(threshold, keep_label, dormant_days), before.schema)
            overwrite_partitions(settled(out, "snapshots"), path, "portee", "run_date")

    return each


def backfill(clusters: DataFrame, path: str, as_of: str, days: int, scope: str | None = None) -> None:
    """The registries over the last days up to as_of, oldest first, since each day starts from the one before."""
    within = F.col("run_date").cast("date").between(F.date_sub(F.lit(as_of).cast("date"), days - 1), F.lit(as_of).cast("date"))
    into_registry(path, scope)(clusters.filter(within), 0)
