import random
from datetime import date

from pyspark.sql import functions as F

from pressloom.operators import topics
from pressloom.streaming import ingest

SCHEMA = "run_date date, scope string, i int, centroid array<double>, label string, top_words string, n int"


def clusters(spark, *rows):
    return spark.createDataFrame([(date.fromisoformat(d), "global", i, c, f"label {i} of {d}", w, n) for d, i, c, w, n in rows], SCHEMA)


def test_registry_across_runs(spark, tmp_path):
    """Topics come back, appear and fall asleep; a day that is run again counts once; an older day isn't read."""
    path = str(tmp_path / "registry")
    made = clusters(
        spark,
        ("2024-01-01", 0, [1.0, 0.0], "a, b", 5), ("2024-01-01", 1, [0.0, 1.0], "c, d", 6),
        ("2024-01-02", 0, [0.0, 2.0], "c, d", 7), ("2024-01-02", 1, [-1.0, 0.0], "e, f", 8),
        ("2024-01-20", 0, [-2.0, 0.1], "x, y", 9),
    )
    for _ in range(2):
        ingest.into_registry(path)(made, 0)
        rows = {(str(r["run_date"]), r["topic_key"]): (r["label"], r["article_count"], str(r["first_seen"]), str(r["last_seen"]), r["active"]) for r in spark.read.parquet(path).collect()}
        assert rows == {
            ("2024-01-01", 1): ("label 0 of 2024-01-01", 5, "2024-01-01", "2024-01-01", True),
            ("2024-01-01", 2): ("label 1 of 2024-01-01", 6, "2024-01-01", "2024-01-01", True),
            ("2024-01-02", 1): ("label 0 of 2024-01-01", 5, "2024-01-01", "2024-01-01", True),
            ("2024-01-02", 2): ("label 1 of 2024-01-01", 13, "2024-01-01", "2024-01-02", True),
            ("2024-01-02", 3): ("label 1 of 2024-01-02", 8, "2024-01-02", "2024-01-02", True),
            ("2024-01-20", 1): ("label 0 of 2024-01-01", 5, "2024-01-01", "2024-01-01", False),
            ("2024-01-20", 2): ("label 1 of 2024-01-01", 13, "2024-01-01", "2024-01-02", False),
            ("2024-01-20", 3): ("label 0 of 2024-01-20", 17, "2024-01-02", "2024-01-20", True),
        }
    other = str(tmp_path / "backfilled")
    ingest.backfill(made, other, "2024-01-02", 2)
    assert {(str(r["run_date"]), r["topic_key"], r["article_count"]) for r in spark.read.parquet(other).collect()} == {(d, k, v[1]) for (d, k), v in rows.items() if d < "2024-01-03"}


def test_runs_that_cross_midnight(spark):
    from pressloom.operators import corpus

    times = ["2024-01-01 22:00:00", "2024-01-01 23:50:00", "2024-01-02 00:10:00", "2024-01-02 00:30:00", "2024-01-02 23:45:00", "2024-01-03 00:05:00", "2024-01-03 02:00:00", "2024-01-05 00:00:00", "2024-01-05 00:00:00", None]
    got = corpus.collection_runs(spark.createDataFrame([(t,) for t in times], "t string").selectExpr("CAST(t AS timestamp) AS t"), "t").selectExpr("CAST(start AS string) AS s", "CAST(end AS string) AS e", "n")
    assert sorted(map(tuple, got.collect())) == [("2024-01-01 22:00:00", "2024-01-01 22:00:00", 1), ("2024-01-01 23:50:00", "2024-01-02 00:30:00", 3), ("2024-01-02 23:45:00", "2024-01-03 00:05:00", 2), ("2024-01-03 02:00:00", "2024-01-03 02:00:00", 1), ("2024-01-05 00:00:00", "2024-01-05 00:00:00", 2)]


def _rows(spark, path):
    return {(r.portee, str(r.run_date), r.topic_key, r.label, r.top_words, tuple(r.centroid), r.article_count, str(r.first_seen), str(r.last_seen), r.active) for r in spark.read.parquet(path).collect()}


def test_scopes_stay_side_by_side_and_late_days_count(spark, tmp_path):
    day = lambda d, scope: clusters(spark, (d, 0, [1.0, 0.0], "a, b", 5)).withColumn("scope", F.lit(scope))
    path = str(tmp_path / "registry")
    ingest.into_registry(path, "global")(day("2024-01-02", "global"), 0)
    ingest.into_registry(path, "tv")(day("2024-01-02", "tv"), 1)
    assert {(x[0], x[6]) for x in _rows(spark, path)} == {("global", 5), ("tv", 5)}
    ingest.into_registry(path, "global")(day("2024-01-01", "global"), 2)
    assert {(x[0], x[1], x[6], x[7]) for x in _rows(spark, path)} == {("tv", "2024-01-02", 5, "2024-01-02"), ("global", "2024-01-01", 5, "2024-01-01"), ("global", "2024-01-02", 10, "2024-01-01")}
    ingest.into_registry(path)(day("2024-01-03", "tv").limit(0), 3)
    assert len(_rows(spark, path)) == 3


def _made(spark):
    """Random clusters of two scopes over 24 days."""
    r = random.Random(3)
    rows = [(date(2024, 1, 1 + d), scope, i, [r.gauss(0, 1) for _ in range(3)], f"{scope} {d} {i}", ", ".join(r.sample("abcdefgh", 4)), r.randint(1, 9)) for scope in ("global", "tv") for d in range(24) for i in range(r.randint(1, 4)) if r.random() < 0.8]
    return spark.createDataFrame(rows, SCHEMA)


def test_any_order_and_restarts_equal_the_operators_day_by_day(spark, tmp_path):
    """Snapshots by DataFrame operators, a day at a time, against all at once, against a stream that is started again with late days."""
    made = _made(spark)
    want = set()
    for scope in ("global", "tv"):
        known = spark.createDataFrame([], topics.REGISTRY)
        for (d,) in made.filter(F.col("scope") == scope).select("run_date").distinct().orderBy("run_date").collect()[:6]:
            new = made.filter((F.col("scope") == scope) & (F.col("run_date") == F.lit(d))).drop("run_date")
            known = topics.update_registry(known, new, topics.greedy_match(new, known, 0.62), str(d), scope=scope)
            rows = known.collect()
            known = spark.createDataFrame(rows, topics.REGISTRY)
            want |= {(scope, str(d), t.topic_key, t.label, t.top_words, tuple(t.centroid), t.article_count, str(t.first_seen), str(t.last_seen), t.active) for t in rows}
    path = str(tmp_path / "registry")
    ingest.into_registry(path)(made, 0)
    once = _rows(spark, path)
    assert want <= once and len({x[1] for x in once}) > ingest.DAYS
    landing, other, state = (str(tmp_path / x) for x in ("landing", "other", "state"))
    for part in (1, 2, 0):
        made.filter(F.dayofmonth("run_date") % 3 == part).coalesce(1).write.mode("append").parquet(landing)
        ingest.drain(spark.readStream.schema(made.schema).parquet(landing), ingest.into_registry(other), state).awaitTermination()
    assert _rows(spark, other) == once
