"""A store with a key index: appends meet the stored keys bucket by bucket, without shuffling them.

Beside the store at `path` lie `path_keys` (kind, key: a row for each id and url
stored, bucketed by both) and `path_log` (two rows an append). An append shuffles
its own keys to the buckets; the index is scanned where it lies, and the store
isn't read at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.sources.sinks import exists, settled

_KEYS = "kind string, key string"
_LOG = "append string, step string, buckets int"


class KeyedStore:
    """Rows at a path that the cluster shares, each key of which is stored once. One writer at a time.

    keys: the columns that must not repeat, each by itself; day: the time whose
    date rows are partitioned by, if any. `buckets` counts when the index is made,
    later the log's number holds: size it so that a bucket's keys fit a task.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("id", "url"), day: str | None = "published_at", buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.day, self.buckets = spark, path.rstrip("/"), keys, day, buckets
        self.index_path, self.log_path = f"{self.path}_keys", f"{self.path}_log"
        self.name = f"keys_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        if exists(spark, self.log_path):
            self.buckets = self._log().agg(F.max("buckets")).first()[0]

    def _log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(self.log_path)

    def _note(self, append: str, *steps: str) -> None:
        self.spark.createDataFrame([(append, s, self.buckets) for s in steps], _LOG).coalesce(1).write.mode("append").parquet(self.log_path)

    def _open(self) -> DataFrame:
        """Appends that have begun and not ended since the index was last made."""
        steps = [F.count_if(F.col("step") == s).alias(s) for s in ("begun", "ended")]
        return self._log().groupBy("append").agg(*steps).filter("begun > ended").select("append")

    def _index(self) -> str:
        """The catalogue's name of the index; made where this session doesn't know it."""
        columns = ", ".join(c.split()[0] for c in _KEYS.split(", "))
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({_KEYS}) USING parquet CLUSTERED BY ({columns}) INTO {self.buckets} BUCKETS LOCATION '{self.index_path}'")
        return self.name

    def keys_of(self, rows: DataFrame) -> DataFrame:
        """kind, key of each key of the rows that isn't null."""
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in self.keys]))
        return rows.select(each.alias("k")).select("k.*").filter("key IS NOT NULL")

    def _write_keys(self, rows: DataFrame, overwrite: bool = False) -> None:
        name = self._index()
        self.keys_of(rows).distinct().repartition(self.buckets, "kind", "key").write.insertInto(name, overwrite=overwrite)
        self.spark.catalog.refreshTable(name)

    def rebuild(self) -> None:
        """The index made again from the store: where there is none, and after an append that was cut off."""
        if exists(self.spark, self.path):
            self._write_keys(self.spark.read.parquet(self.path), overwrite=True)
        if not exists(self.spark, self.log_path):
            self._note("index", "begun", "ended")
        for r in self._open().collect():  # with one writer, one at most
            self._note(r["append"], "ended")

    def known(self, rows: DataFrame) -> DataFrame:
        """kind, key: those of the rows' keys that are stored. Only the rows' side is shuffled."""
        return self.spark.table(self._index()).join(self.keys_of(rows).distinct(), ["kind", "key"]).distinct()

    def unknown(self, rows: DataFrame) -> DataFrame:
        """The rows of which no key is stored; of those that share a key one. A null key matches nothing."""
        known, out = self.known(rows), rows
        for k in self.keys:
            out = out.join(known.filter(F.col("kind") == k).select(F.col("key").alias(k)), k, "left_anti")
        for k in self.keys:
            out = out.filter(F.col(k).isNotNull()).dropDuplicates([k]).unionByName(out.filter(F.col(k).isNull()))
        return out.select(rows.columns)

    def append(self, rows: DataFrame) -> None:
        """Append the rows that aren't stored, then their keys.

        In between the append is open: after a failure the next one makes the index
        again from the store first, so what was written counts as stored and a
        repeated append adds only the rest.
        """
        if not exists(self.spark, self.log_path) or not self._open().isEmpty():
            self.rebuild()
        append = uuid.uuid4().hex
        new = settled(self.unknown(rows), "append")
        self._note(append, "begun")
        self._write_rows(new)
        self._write_keys(new)
        self._note(append, "ended")

    def _write_rows(self, new: DataFrame) -> None:
        if self.day is None:
            new.write.mode("append").parquet(self.path)
        else:
            new.withColumn("published_date", F.to_date(self.day)).write.mode("append").partitionBy("published_date").parquet(self.path)

    def forget(self) -> None:
        """Take the index out of the session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
