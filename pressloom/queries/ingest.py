"""Ingestion, changes to stored tables, exports and streams, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.operators import maintenance, topics
from pressloom.plans.articles import AS_OF, VIEWS, articles, assignments, sentiment, table, techniques, topic_names, topic_quality
from pressloom.registry import query
from pressloom.sources import landed, sinks
from pressloom.sources.keyed import KeyedStore
from pressloom.sources.sinks import scratch_path as _scratch
from pressloom.streaming import ingest


@query("snk01", f"{VIEWS} SELECT count(*)::BIGINT AS n, count(DISTINCT id)::BIGINT AS ids FROM A")
def snk01(spark, sf_dir):
    """Half of the articles appended, then all of them twice: each is stored once."""
    path, a = _scratch(spark, "articles"), articles(spark, sf_dir)
    store = KeyedStore(spark, path, buckets=8)
    for part in (a.filter("doc_id % 2 = 0"), a, a):
        store.append(part)
    store.forget()
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("snk02", f"{VIEWS} SELECT 'articles' AS name, count(*)::BIGINT AS n FROM A UNION ALL SELECT 'sentiment', count(*)::BIGINT FROM S UNION ALL SELECT 'assignments', count(*)::BIGINT FROM ASG")
def snk02(spark, sf_dir):
    path = _scratch(spark, "snapshot")
    tables = {"articles": articles(spark, sf_dir), "sentiment": sentiment(spark, sf_dir), "assignments": assignments(spark, sf_dir)}
    sinks.export_snapshot(tables, path)
    out = None
    for name in tables:
        rows = spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("snk06", f"{VIEWS} SELECT count(*) FILTER (doc_id % 3 = 0)::BIGINT AS known, count(*) FILTER (doc_id % 3 <> 0)::BIGINT AS open FROM A")
def snk06(spark, sf_dir):
    asked = articles(spark, sf_dir).select(F.col("id").alias("video"), "doc_id")
    known, unknown = sinks.verdicts(spark, asked.filter("doc_id % 3 = 0").select("video", F.lit(True).alias("political")), asked)
    return known.agg(F.count("*").alias("known")).join(unknown.agg(F.count("*").alias("open")))


@query("src01", f"{VIEWS} SELECT left(sha256(url), 16) AS id, count(*)::BIGINT AS n FROM A GROUP BY 1")
def src01(spark, sf_dir):
    """Articles written as a feed and read back."""
    path = _scratch(spark, "feed")
    a = articles(spark, sf_dir)
    items = a.select("title", F.col("url").alias("link"), "author", F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss '+0000'").alias("pubDate"))
    items.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    return landed.feed(spark, path).groupBy("id").agg(F.count("*").alias("n"))


@query("src07", "WITH t AS (SELECT conv_id, turn, trim(replace(text, chr(10), ' ')) AS text FROM conversations), f AS (SELECT * FROM t WHERE length(text) > 0), l AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM f) SELECT CAST(conv_id AS VARCHAR) AS video, count(*)::BIGINT AS cues FROM l WHERE before IS NULL OR before <> text GROUP BY 1")
def src07(spark, sf_dir):
    """Conversations written as caption files and read back as cues."""
    path = _scratch(spark, "captions")
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("video")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("c"))
    rows.select("video", F.transform("c", lambda x: F.struct((x["turn"] * 1000.0).alias("tStartMs"), F.array(F.struct(x["text"].alias("utf8"))).alias("segs"))).alias("events")).write.json(path)
    return landed.captions(spark, path).select("video", F.size("cues").cast("long").alias("cues"))


@query("src09", f"{VIEWS}, r AS (SELECT source_name, id AS video, row_number() OVER (PARTITION BY source_name ORDER BY published_at DESC, id) AS r FROM A WHERE doc_id % 7 <> 0 AND published_at >= DATE '2024-01-31' - INTERVAL 21 DAY AND doc_id % 4000 + 100 BETWEEN 180 AND 14400) SELECT source_name, video FROM r WHERE r <= 2")
def src09(spark, sf_dir):
    found = articles(spark, sf_dir).select("source_name", F.col("id").alias("video"), "title", "published_at", "doc_id", (F.col("doc_id") % 4000 + 100).alias("duration"), F.lit(1).alias("author_id"))
    seen = found.filter("doc_id % 7 = 0").select("video")
    return landed.episodes(found, F.lit(1), F.lit("."), "2024-01-31", seen=seen).select("source_name", "video")


@query("src12", f"{VIEWS} SELECT left(sha256(url), 16) AS id, strftime(TIMESTAMP '2024-02-01 12:00:00' - to_hours(doc_id % 20 + 1), '%Y-%m-%d %H:%M') AS dt FROM A WHERE length(content) >= 80")
def src12(spark, sf_dir):
    posts = articles(spark, sf_dir).select("source_name", "url", F.col("content").alias("text"), F.concat((F.col("doc_id") % 20 + 1).cast("string"), F.lit(" час назад")).alias("label"))
    return landed.wall_posts(posts, "2024-02-01 12:00:00").select("id", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("dt"))


@query("set03", f"{VIEWS} SELECT count(*)::BIGINT AS n FROM A WHERE doc_id % 3 <> 0")
def set03(spark, sf_dir):
    a = articles(spark, sf_dir).select("id", "url", "doc_id")
    return maintenance.insert_new(a.filter("doc_id % 3 = 0"), a.unionByName(a)).agg(F.count("*").alias("n"))


@query("join14", f"{VIEWS} SELECT url FROM A WHERE doc_id % 5 = 0")
def join14(spark, sf_dir):
    """Addresses of a feed that aren't stored."""
    a = articles(spark, sf_dir).select("url", "doc_id")
    return a.join(a.filter("doc_id % 5 <> 0").select("url"), "url", "left_anti").select("url")


@query("join15", f"{VIEWS} SELECT name FROM (SELECT 'src' || i AS name FROM range(25) t(i)) WHERE name NOT IN (SELECT source_name FROM A)")
def join15(spark, sf_dir):
    """Configured sources without a document."""
    config = spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("name"))
    return config.join(articles(spark, sf_dir).select(F.col("source_name").alias("name")).distinct(), "name", "left_anti")


@query("dml02", f"{VIEWS} SELECT target, round(sum(score), 6) AS score, count(*)::BIGINT AS n FROM (SELECT article_id, target, CASE WHEN doc_id % 4 = 0 THEN 1.0 ELSE score END AS score FROM S) GROUP BY 1")
def dml02(spark, sf_dir):
    s = sentiment(spark, sf_dir).select("article_id", "target", "score", "doc_id")
    out = maintenance.upsert(s, s.filter("doc_id % 4 = 0").withColumn("score", F.lit(1.0)), ["article_id", "target"])
    return out.groupBy("target").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("n"))


@query("dml03", f"{VIEWS} SELECT portee, count(*)::BIGINT AS n FROM ASG GROUP BY 1")
def dml03(spark, sf_dir):
    """Assignments stored by scope, one scope written again: nothing doubles."""
    path, a = _scratch(spark, "assignments"), assignments(spark, sf_dir)
    maintenance.overwrite_partitions(a, path, "portee")
    maintenance.overwrite_partitions(a.filter("portee = 'tv'"), path, "portee")
    return spark.read.parquet(path).groupBy("portee").agg(F.count("*").alias("n"))


@query("dml04", f"{VIEWS} SELECT id, coalesce(author, 'unsigned') AS author FROM A")
def dml04(spark, sf_dir):
    return maintenance.repaired(articles(spark, sf_dir), author=F.lit("unsigned")).select("id", "author")


@query("dml05", f"{VIEWS}, g AS (SELECT id FROM A WHERE source_name = 'src2') SELECT 'articles' AS name, count(*)::BIGINT AS n FROM A WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'sentiment', count(*)::BIGINT FROM S WHERE article_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'techniques', count(*)::BIGINT FROM X WHERE article_id NOT IN (SELECT id FROM g)")
def dml05(spark, sf_dir):
    a = articles(spark, sf_dir)
    left = maintenance.cascade({"articles": (a, "id"), "sentiment": (sentiment(spark, sf_dir), "article_id"), "techniques": (techniques(spark, sf_dir), "article_id")}, a.filter("source_name = 'src2'").select("id"))
    out = None
    for name, df in left.items():
        n = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("dml08", f"{VIEWS} SELECT topic_key::INTEGER AS topic_key, count(*)::BIGINT AS n FROM Q WHERE topic_key IN (SELECT topic_key FROM T WHERE active) GROUP BY 1")
def dml08(spark, sf_dir):
    return maintenance.live_only(topic_quality(spark, sf_dir), topic_names(spark, sf_dir).filter("active")).groupBy("topic_key").agg(F.count("*").alias("n"))


@query("dml09", f"{VIEWS} SELECT article_id, portee, count(*)::BIGINT AS n FROM ASG GROUP BY 1, 2")
def dml09(spark, sf_dir):
    """Rows of before scopes existed, without the column or null in it, become the whole's."""
    a = assignments(spark, sf_dir)
    whole = a.filter("portee = 'global'")
    older = maintenance.with_default(whole.filter("doc_id % 3 = 0").drop("portee"), "portee", "global")
    old = maintenance.with_default(whole.filter("doc_id % 3 <> 0").withColumn("portee", F.lit(None).cast("string")), "portee", "global")
    return old.unionByName(older).unionByName(a.filter("portee <> 'global'")).groupBy("article_id", "portee").agg(F.count("*").alias("n"))


@query("dml10", f"{VIEWS} SELECT label, (100 + row_number() OVER (ORDER BY label))::INTEGER AS topic_key FROM T")
def dml10(spark, sf_dir):
    return maintenance.numbered(topic_names(spark, sf_dir).select("label"), 100, "topic_key", "label")


def _stream(spark, sf_dir, make, mode="append"):
    """Drain the events through a streaming query into a new table and read it."""
    path, state = _scratch(spark, "stream"), _scratch(spark, "state")
    source = table(spark, sf_dir, "events")
    rows = ingest.events(spark, _events_dir(spark, sf_dir), source.schema)
    out = make(rows)

    def each(batch, number):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    q = ingest.drain(out, each, state, mode)
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def _events_dir(spark, sf_dir):
    """A folder that holds the events as files (streams read folders)."""
    path = _scratch(spark, "events")
    table(spark, sf_dir, "events").write.parquet(path)
    return path


@query("str01", "SELECT count(*)::BIGINT AS n FROM (SELECT DISTINCT event_id FROM events)")
def str01(spark, sf_dir):
    return _stream(spark, sf_dir, lambda r: ingest.deduplicated(r, "event_id").select("event_id")).agg(F.count("*").alias("n"))


@query("str03", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS \"start\", event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def str03(spark, sf_dir):
    """Daily counts of the whole stream in complete mode, equal to the batch's."""
    out = _stream(spark, sf_dir, lambda r: ingest.tumbling(r, "ts", "1 day", "1 day", "event_type"), "complete")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("str04", "SELECT strftime(d - to_days(k::INTEGER), '%Y-%m-%d %H:%M') AS \"start\", count(*)::BIGINT AS n FROM (SELECT date_trunc('day', ts) AS d FROM events) e, range(7) t(k) GROUP BY 1")
def str04(spark, sf_dir):
    out = _stream(spark, sf_dir, lambda r: ingest.sliding(r, "ts", "1 day", "7 days", "1 day"), "complete")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def _closed(spark, sf_dir, make):
    """The windows of the events that a stream has closed: written as they close, read back."""
    path, source = _scratch(spark, "windows"), table(spark, sf_dir, "events")
    out = make(ingest.events(spark, _events_dir(spark, sf_dir), source.schema))
    ingest.drain(out, ingest.into_windows(path), _scratch(spark, "state")).awaitTermination()
    return spark.read.parquet(path).select(out.columns).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("str03_closed", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS \"start\", event_type, count(*)::BIGINT AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2")
def str03_closed(spark, sf_dir):
    """Daily counts of the days that are over: a day behind the latest event nothing can come."""
    return _closed(spark, sf_dir, lambda r: ingest.tumbling(r, "ts", "1 day", "1 day", "event_type"))


@query("str04_closed", "SELECT strftime(d - to_days(k::INTEGER), '%Y-%m-%d %H:%M') AS \"start\", count(*)::BIGINT AS n FROM (SELECT date_trunc('day', ts) AS d FROM events) e, range(7) t(k) WHERE d - to_days(k::INTEGER) + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1")
def str04_closed(spark, sf_dir):
    """The same over windows of seven days."""
    return _closed(spark, sf_dir, lambda r: ingest.sliding(r, "ts", "1 day", "7 days", "1 day"))


@query("dml07", f"{VIEWS} SELECT 'articles' AS name, count(*)::BIGINT AS n FROM A")
def dml07(spark, sf_dir):
    """Articles and two tables derived from them; the derived ones are dropped."""
    run = _scratch(spark, "reset")
    prefix = f"run_{run.rpartition('-')[2]}"
    made = {"articles": articles(spark, sf_dir).select("id", "url"), "sentiment": sentiment(spark, sf_dir), "assignments": assignments(spark, sf_dir)}
    for name, df in made.items():
        df.write.option("path", f"{run}/{name}").saveAsTable(f"{prefix}__{name}")
    maintenance.drop_derived(spark, [f"{prefix}__{name}" for name in made])
    out = None
    for name in [n for n in made if spark.catalog.tableExists(f"{prefix}__{n}")]:
        n = spark.table(f"{prefix}__{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    counted = sinks.settled(out, "counted")
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}__{name}")
    return counted


_TYPE = "CASE CAST(substr(source_name, 4) AS BIGINT) % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'telegram' WHEN 2 THEN 'hls' ELSE 'vk' END"


@query("src15", f"{VIEWS} SELECT CASE {_TYPE} WHEN 'rss' THEN 'press' WHEN 'hls' THEN 'tv' ELSE {_TYPE} END AS kind, count(*)::BIGINT AS n FROM A GROUP BY 1")
def src15(spark, sf_dir):
    """The sources as a YAML catalogue, read back and joined to their articles: articles by the kind that follows from the collector."""
    path, a = _scratch(spark, "catalogue"), articles(spark, sf_dir).select("source_name")
    entry = F.concat(F.lit("  - name: "), "source_name", F.lit("\n    type: "), F.expr(_TYPE))
    lines = a.distinct().agg(F.concat(F.lit("sources:\n"), F.concat_ws("\n", F.sort_array(F.collect_list(entry)))).alias("value"))  # a few dozen entries
    lines.coalesce(1).write.text(path)
    known = landed.catalogue(spark, path).select(F.col("name").alias("source_name"), F.col("source_kind").alias("kind"))
    return a.groupBy("source_name").agg(F.count("*").alias("n")).join(F.broadcast(known), "source_name").groupBy("kind").agg(F.sum("n").alias("n"))


def _clusters(spark, sf_dir):
    """Every scope's clusters of every day: topics by day, their mean vectors and sizes."""
    day = assignments(spark, sf_dir).filter("topic_key > 0 AND run_date IS NOT NULL").select(F.col("doc_id").alias("vec_id"), "topic_key", "run_date", "portee")
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x")).join(day, "vec_id")
    mean = x.groupBy("run_date", "portee", "topic_key", "p").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    by = mean.groupBy("run_date", F.col("portee").alias("scope"), F.col("topic_key").cast("int").alias("i")).agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("c"), F.max("n").alias("n"))
    return by.select("run_date", "scope", "i", F.transform("c", lambda s: s["x"]).alias("centroid"), F.expr("'theme ' || i").alias("label"), F.expr("'k' || i || ', common'").alias("top_words"), "n")


def _totals(spark, path):
    """Of each scope's snapshot of each day: topics seen that day, articles so far, first day."""
    empty = spark.createDataFrame([], f"{topics.REGISTRY}, run_date date")
    s = spark.read.schema(empty.schema).parquet(path) if sinks.exists(spark, path) else empty
    n = s.groupBy("run_date", "portee").agg(F.count_if(F.col("last_seen") == F.col("run_date")).alias("seen"), F.sum("article_count").alias("articles"), F.min("first_seen").alias("first"))
    return n.select(F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "portee", "seen", "articles", F.date_format("first", "yyyy-MM-dd").alias("first"))


def _totals_sql(kept):
    return f"""{VIEWS}, k AS (SELECT run_date, portee, topic_key, count(*) AS n FROM ASG JOIN embeddings ON vec_id = doc_id WHERE topic_key > 0 AND run_date IS NOT NULL GROUP BY ALL),
 y AS (SELECT run_date, portee, count(*)::BIGINT AS seen, sum(n) AS n FROM k WHERE {kept} GROUP BY ALL)
 SELECT strftime(run_date, '%Y-%m-%d') AS run_date, portee, seen, (sum(n) OVER w)::BIGINT AS articles, strftime(min(run_date) OVER w, '%Y-%m-%d') AS first FROM y WINDOW w AS (PARTITION BY portee ORDER BY run_date)"""


@query("str08", _totals_sql("true"))
def str08(spark, sf_dir):
    """Registries of all scopes, kept by a stream that is stopped and started again; days of even number and one scope arrive late, after the rest."""
    landing, path, state = _scratch(spark, "clusters"), _scratch(spark, "registry"), _scratch(spark, "state")
    made = sinks.settled(_clusters(spark, sf_dir), "clusters")
    late = (F.dayofmonth("run_date") % 2 == 0) | (F.col("scope") == "tv")
    for part in (made.filter(~late), made.filter(late)):
        part.coalesce(1).write.mode("append").parquet(landing)
        ingest.drain(spark.readStream.schema(made.schema).parquet(landing), ingest.into_registry(path), state).awaitTermination()
    return _totals(spark, path)


@query("ml10", _totals_sql("run_date > (SELECT max(run_date) FROM k) - INTERVAL 10 DAY"))
def ml10(spark, sf_dir):
    """The same by backfill of the last ten days, oldest first, twice: the second run changes nothing."""
    path, made = _scratch(spark, "registry"), sinks.settled(_clusters(spark, sf_dir), "clusters")
    last = made.agg(F.coalesce(F.max("run_date"), F.lit(AS_OF).cast("date")).cast("string")).first()[0]
    for _ in range(2):
        ingest.backfill(made, path, last, 10)
    return _totals(spark, path)
