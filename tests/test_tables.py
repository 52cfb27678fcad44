from pyspark.sql import functions as F

from pressloom import schemas
from pressloom.functions import scoring
from pressloom.operators import maintenance, opinions, signals
from pressloom.sources import landed, sinks
from pressloom.streaming import ingest


def articles(spark, ids):
    return spark.createDataFrame([(f"i{i}", f"u{i}", i) for i in ids], "id string, url string, view_count long").withColumn("published_at", F.lit("2024-01-02").cast("timestamp"))


def test_append_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "a")
    for ids in (range(5), range(8), range(8)):
        sinks.append_articles(spark, articles(spark, [*ids, *ids]), path)
    assert spark.read.parquet(path).count() == 8


def test_swap_a_table_computed_from_itself(spark):
    spark.sql("DROP TABLE IF EXISTS kept")
    articles(spark, range(6)).select("id").write.saveAsTable("kept")
    maintenance.swap(spark, spark.table("kept").filter("id <> 'i3'"), "kept")
    assert spark.table("kept").count() == 5
    assert schemas.table_or_empty(spark, "never_made", schemas.TOPICS_DDL).count() == 0


def test_conform_fills_and_casts(spark):
    out = schemas.conform(spark.createDataFrame([("a", "3")], "id string, view_count string"), schemas.ARTICLES_DDL).first()
    assert (out["id"], out["view_count"], out["source_kind"], out["content"]) == ("a", 3, "press", None)


def test_latest_wins(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "k int, v string, t int")
    assert {r["k"]: r["v"] for r in opinions.latest_wins(df, ["k"], F.col("t")).collect()} == {1: "y", 2: "z"}


def test_windows_meet(spark):
    days = ["2023-12-31", "2024-01-01", "2024-01-07", "2024-01-08", "2024-01-14", "2024-01-15"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(signals.window_flag(F.col("d").cast("timestamp"), "2024-01-14", 7).alias("w"))
    assert [r["w"] for r in df.collect()] == [None, "prior", "prior", "recent", "recent", None]


def test_volume_gate(spark):
    def n(recent, prior):
        rows = [("2024-01-10",)] * recent + [("2024-01-03",)] * prior
        return signals.volume_change(spark.createDataFrame(rows, "d string").select(F.col("d").cast("timestamp").alias("published_at")), "2024-01-14", 7).first()

    assert n(100, 100)["comparable"] and not n(99, 100)["comparable"] and not n(151, 100)["comparable"] and n(150, 100)["comparable"]
    assert n(5, 0)["ratio"] is None and not n(5, 0)["comparable"]


def test_catalogue(spark, tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("sources:\n- {name: A, url: 'https://a.org', type: rss, media_type: etat}\n- {name: B, url: 'https://b.org', type: hls}\n")
    assert [(r["name"], r["source_kind"]) for r in landed.catalogue(spark, str(path)).orderBy("name").collect()] == [("A", "press"), ("B", "tv")]


def test_feed(spark, tmp_path):
    path = tmp_path / "f.xml"
    path.write_text("<rss><channel><item><title> T </title><link>https://a.org/1</link><pubDate>Tue, 05 Mar 2024 10:20:30 +0000</pubDate></item><item><title>no link</title></item></channel></rss>")
    rows = landed.feed(spark, str(path)).collect()
    assert [(r["title"], str(r["published_at"])) for r in rows] == [("T", "2024-03-05 10:20:30")]


def test_sentiment_is_idempotent_and_valid(spark):
    docs = spark.createDataFrame([("a", "nato good good"), ("b", "nothing"), ("c", "nato bad")], "id string, content string")
    run = lambda done=None: scoring.sentiment_rows(docs, F.col("content").contains("nato"), lambda: scoring.LexiconScorer({"otan": ["nato"]}, ["good"], ["bad"]), ["otan", "iran"], done)
    rows = {(r["article_id"], r["target"]): r["stance"] for r in run().collect()}
    assert rows == {("a", "otan"): "pro", ("a", "iran"): "non_concerne", ("b", "otan"): "non_concerne", ("b", "iran"): "non_concerne", ("c", "otan"): "anti", ("c", "iran"): "non_concerne"}
    assert run(run()).count() == 0


def test_technique_replies(spark):
    reply = '{"techniques": [{"technique": "doute", "confiance": "3", "extrait": "x"}, {"technique": "unknown"}, {"technique": "slogan", "confiance": "x"}, {"technique": "doute"}, {"technique": "slogan"}]}'
    rows = scoring.technique_rows(spark.createDataFrame([("a", reply), ("b", "not json")], "id string, reply string"), ["doute", "slogan"]).collect()
    assert [(r["technique"], r["confiance"]) for r in rows] == [("doute", 1.0), ("slogan", 0.0), ("doute", 0.0)]


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i % 9:02d} 0{i % 10}:00:00") for i in range(200)]
    df = spark.createDataFrame(rows, "event_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.coalesce(1).write.parquet(source)
    stream = ingest.tumbling(ingest.events(spark, source, df.schema))
    ingest.drain(stream, lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / "state")).awaitTermination()
    got = {r["start"]: r["n"] for r in spark.read.parquet(out).collect()}
    batch = {r["d"]: r["n"] for r in df.groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert got and all(batch[k] == n for k, n in got.items()) and max(batch) not in got


def test_stream_into_articles_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "a")
    each = ingest.into_articles(path)
    for n in range(2):
        each(articles(spark, [1, 2, 2, 3]), n)
    assert spark.read.parquet(path).count() == 3


def test_late_dates(spark):
    stored = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2024-01-01', NULL), (2, NULL, NULL), (3, NULL, TIMESTAMP'2024-08-01'), (4, NULL, TIMESTAMP'2024-08-01'), (NULL, NULL, NULL) AS t(id, published_at, fetched_at)")
    page = '<meta property="article:published_time" content="2024-03-06">'
    pages = spark.createDataFrame([(1, "u", page), (2, "u", "<p>none</p>"), (3, "u", page), (3, "u", page), (9, "u", page)], "id int, url string, html string")
    rows = maintenance.late_dates(stored, pages).collect()
    got = {r["id"]: (str(r["published_at"])[:10], r["method"]) for r in rows}
    assert len(rows) == 5
    assert got == {1: ("2024-01-01", "kept"), 2: ("None", None), 3: ("2024-03-06", "meta"), 4: ("2024-08-01", "fetched"), None: ("None", None)}


def test_late_dates_with_clashing_names(spark):
    from pressloom.operators import maintenance

    stored = spark.createDataFrame([("a", None, None, 1, 2), ("b", None, None, 3, 4)], "id string, published_at timestamp, fetched_at timestamp, __d int, found int")
    pages = spark.createDataFrame([("a", "https://x.org/2024/01/02/a", "<p>x</p>")], "id string, url string, html string")
    got = {r.id: (r["__d"], r.found, r.method) for r in maintenance.late_dates(stored, pages).collect()}
    assert got["b"] == (3, 4, None) and got["a"][:2] == (1, 2)
