"""Topics: reporting, quality, vectors, technique rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.functions.columns import share
from pressloom.operators import corpus, density, filters, maintenance, topics
from pressloom.plans.articles import AS_OF, PARENT, VIEWS, articles, assignments, supports, table, techniques, topic_names, topic_quality
from pressloom.plans.articles import topics as registry
from pressloom.registry import query
from pressloom.sources.sinks import settled

_D = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
_KEPT = "language = 'en'"


@query("join02", f"{VIEWS} SELECT ASG.topic_key::INTEGER AS topic_key, A.source_kind, count(*)::BIGINT AS n FROM ASG JOIN A ON A.id = ASG.article_id WHERE ASG.portee = 'global' GROUP BY ALL")
def join02(spark, sf_dir):
    a = assignments(spark, sf_dir).filter("portee = 'global'").select("article_id", "topic_key")
    return a.join(articles(spark, sf_dir), F.col("article_id") == F.col("id")).groupBy("topic_key", "source_kind").agg(F.count("*").alias("n"))


_SIZES = f"z AS (SELECT T.topic_key::INTEGER AS topic_key, T.label, T.top_words, T.active, count(A.id)::BIGINT AS n FROM T LEFT JOIN ASG ON T.topic_key = ASG.topic_key AND ASG.portee = 'global' LEFT JOIN A ON A.id = ASG.article_id WHERE A.id IS NULL OR A.{_KEPT} GROUP BY ALL)"


def _sizes(spark, sf_dir):
    return topics.sizes(topic_names(spark, sf_dir), assignments(spark, sf_dir), articles(spark, sf_dir), F.expr(_KEPT))


@query("agg05", f"{VIEWS}, {_SIZES} SELECT *, round(100.0::DOUBLE * n / sum(n) OVER (), 1) AS pct FROM z")
def agg05(spark, sf_dir):
    return _sizes(spark, sf_dir)


@query("join04", f"{VIEWS}, {_SIZES} SELECT label, n FROM z")
def join04(spark, sf_dir):
    return _sizes(spark, sf_dir).select("label", "n")


@query("srt09", f"{VIEWS}, {_SIZES}, r AS (SELECT label, n, row_number() OVER (ORDER BY n DESC, topic_key)::INTEGER AS rank FROM z) SELECT * FROM r WHERE rank BETWEEN 5 AND 8")
def srt09(spark, sf_dir):
    return topics.page_of(_sizes(spark, sf_dir), 1, 4).select("label", "n", "rank")


@query("agg09", f"""{VIEWS}, c AS (SELECT run_date, topic_key, count(*) AS n FROM ASG WHERE portee = 'global' AND run_date IS NOT NULL AND topic_key >= 0 GROUP BY ALL), d AS (SELECT *, sum(n) OVER (PARTITION BY run_date) AS t FROM c),
 top AS (SELECT topic_key FROM c GROUP BY 1 ORDER BY sum(n) DESC, topic_key LIMIT 15) SELECT strftime(run_date, '%Y-%m-%d') AS jour, label AS theme, n::BIGINT AS n, round(100.0::DOUBLE * n / t, 6) AS part FROM d SEMI JOIN top USING (topic_key) JOIN T USING (topic_key)""")
def agg09(spark, sf_dir):
    return topics.daily_shares(assignments(spark, sf_dir), topic_names(spark, sf_dir), "global").withColumn("jour", F.date_format("jour", "yyyy-MM-dd"))


_THEMES = lambda a, b: f"""SELECT T.label AS theme, n::BIGINT AS n, coalesce(supports, '') AS supports FROM (SELECT topic_key, count(*) AS n FROM ASG WHERE portee = 'global' AND topic_key >= 0 AND run_date BETWEEN DATE '{a}' AND DATE '{b}' GROUP BY 1) x JOIN T USING (topic_key)
 LEFT JOIN (SELECT topic_key, string_agg(DISTINCT source_kind, '+' ORDER BY source_kind) AS supports FROM TS WHERE run_date BETWEEN DATE '{a}' AND DATE '{b}' GROUP BY 1) y USING (topic_key)"""  # noqa: E731
_NOW, _BEFORE = ("2024-01-08", "2024-01-14"), ("2024-01-01", "2024-01-07")


def _themes(spark, sf_dir, span):
    return topics.period_themes(assignments(spark, sf_dir), topic_names(spark, sf_dir), supports(spark, sf_dir), *span)


@query("agg10", f"{VIEWS} {_THEMES(*_NOW)}")
def agg10(spark, sf_dir):
    return _themes(spark, sf_dir, _NOW)


_DRIFT = f"""now AS ({_THEMES(*_NOW)}), was AS ({_THEMES(*_BEFORE)}), pa AS (SELECT theme, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS part FROM now), pb AS (SELECT theme, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS was FROM was)"""


@query("win11", f"{VIEWS}, {_DRIFT} SELECT theme, part, round(part - was, 6) AS ecart, CASE WHEN was IS NULL THEN 'new' WHEN part IS NULL THEN 'gone' ELSE 'kept' END AS state FROM pa FULL JOIN pb USING (theme)")
def win11(spark, sf_dir):
    return topics.drifted(assignments(spark, sf_dir), topic_names(spark, sf_dir), _NOW, _BEFORE).drop("was")


@query("join17", f"{VIEWS}, {_DRIFT} SELECT theme, part, was FROM pa LEFT JOIN pb USING (theme)")
def join17(spark, sf_dir):
    return topics.drifted(assignments(spark, sf_dir), topic_names(spark, sf_dir), _NOW, _BEFORE).filter("part IS NOT NULL").select("theme", "part", "was")


@query("set05", f"{VIEWS}, now AS ({_THEMES('2024-01-31', '2024-01-31')}), was AS ({_THEMES(*_BEFORE)}) SELECT theme FROM was WHERE theme NOT IN (SELECT theme FROM now) ORDER BY theme LIMIT 12")
def set05(spark, sf_dir):
    gone = _themes(spark, sf_dir, _BEFORE).select("theme").join(_themes(spark, sf_dir, ("2024-01-31", "2024-01-31")).select("theme"), "theme", "left_anti")
    return gone.orderBy("theme").limit(12)


@query("agg11", f"{VIEWS} SELECT count(*) FILTER (topic_key >= 0)::BIGINT AS n_classified, count(*)::BIGINT AS n_total FROM ASG WHERE portee = 'global' AND run_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'")
def agg11(spark, sf_dir):
    return topics.classified(assignments(spark, sf_dir), *_NOW)


@query("agg12", f"""{VIEWS}, b AS (SELECT topic_key, source_kind AS support, sum(n_docs)::BIGINT AS n_docs, min(top_words) AS top_words FROM TS WHERE run_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 1, 2)
 SELECT T.label AS theme, support, n_docs, b.top_words, count(*) OVER (PARTITION BY topic_key)::BIGINT AS n_supports FROM b JOIN T USING (topic_key)""")
def agg12(spark, sf_dir):
    return topics.support_breakdown(supports(spark, sf_dir), topic_names(spark, sf_dir), *_NOW)


_QUALITY = "qq AS (SELECT topic_key::INTEGER AS topic_key, T.label, categorie, round(coherence, 6) AS coherence, round(distinction, 6) AS distinction, coherence < 0.5 OR distinction < 0.5 AS weak FROM Q JOIN T USING (topic_key) WHERE run_date = (SELECT max(run_date) FROM Q))"


@query("agg13", f"{VIEWS}, {_QUALITY} SELECT * FROM qq")
def agg13(spark, sf_dir):
    return topics.latest_quality(topic_quality(spark, sf_dir), topic_names(spark, sf_dir))


@query("agg13_means", f"{VIEWS}, {_QUALITY} SELECT round(avg(coherence), 6) AS coherence, round(avg(distinction), 6) AS distinction, count(*) FILTER (weak)::BIGINT AS fragile FROM qq")
def agg13_means(spark, sf_dir):
    return topics.latest_quality(topic_quality(spark, sf_dir), topic_names(spark, sf_dir)).agg(F.round(F.avg("coherence"), 6).alias("coherence"), F.round(F.avg("distinction"), 6).alias("distinction"), F.count_if("weak").alias("fragile"))


@query("join12", f"{VIEWS} SELECT topic_key::INTEGER AS topic_key FROM Q WHERE run_date = (SELECT max(run_date) FROM Q)")
def join12(spark, sf_dir):
    q = topic_quality(spark, sf_dir)
    return q.join(F.broadcast(q.agg(F.max("run_date").alias("run_date"))), "run_date").select("topic_key")


def _drill(spark, sf_dir):
    a = assignments(spark, sf_dir).filter("portee = 'global' AND topic_key = 3").select("article_id", "probability")
    return a.join(articles(spark, sf_dir), F.col("article_id") == F.col("id"))


_DR = "dr AS (SELECT A.*, ASG.probability FROM ASG JOIN A ON A.id = ASG.article_id WHERE ASG.portee = 'global' AND ASG.topic_key = 3)"


@query("agg14", f"{VIEWS}, {_DR} SELECT source_name, count(*)::BIGINT AS n FROM dr GROUP BY 1 ORDER BY n DESC, source_name LIMIT 10")
def agg14(spark, sf_dir):
    return corpus.ranked(_drill(spark, sf_dir).groupBy("source_name").agg(F.count("*").alias("n")), ["source_name"], 10)


@query("agg14_series", f"{VIEWS}, {_DR} SELECT strftime(date_trunc('week', published_at), '%Y-%m-%d') AS period, count(*)::BIGINT AS n FROM dr WHERE published_at IS NOT NULL GROUP BY 1")
def agg14_series(spark, sf_dir):
    return _drill(spark, sf_dir).filter("published_at IS NOT NULL").groupBy(F.date_format(F.date_trunc("week", "published_at"), "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("n"))


@query("agg14_kinds", f"{VIEWS}, {_DR} SELECT source_kind, count(*)::BIGINT AS n FROM dr GROUP BY 1")
def agg14_kinds(spark, sf_dir):
    return _drill(spark, sf_dir).groupBy("source_kind").agg(F.count("*").alias("n"))


@query("srt04", f"{VIEWS}, {_DR} SELECT id, source_name FROM dr ORDER BY published_at DESC NULLS LAST, id LIMIT 50")
def srt04(spark, sf_dir):
    return _drill(spark, sf_dir).orderBy(F.col("published_at").desc_nulls_last(), "id").limit(50).select("id", "source_name")


@query("srt04_techniques", f"{VIEWS} SELECT article_id, technique, confiance FROM X WHERE technique = 'slogan' ORDER BY confiance DESC, article_id LIMIT 15")
def srt04_techniques(spark, sf_dir):
    return techniques(spark, sf_dir).filter("technique = 'slogan'").orderBy(F.desc("confiance"), "article_id").limit(15).select("article_id", "technique", "confiance")


@query("srt08", f"{VIEWS}, r AS (SELECT topic_key::INTEGER AS topic_key, article_id, row_number() OVER (PARTITION BY topic_key ORDER BY probability DESC, article_id)::INTEGER AS rank FROM ASG WHERE portee = 'global' AND topic_key >= 0) SELECT * FROM r WHERE rank <= 11")
def srt08(spark, sf_dir):
    return topics.representative(assignments(spark, sf_dir).filter("portee = 'global'")).select("topic_key", "article_id", "rank")


@query("agg32", f"""{VIEWS}, tt AS (SELECT source_kind AS nature, count(*) AS total FROM A GROUP BY 1) SELECT technique, A.source_kind AS nature, round(100.0::DOUBLE * count(*) / any_value(tt.total), 6) AS pour_100 FROM X JOIN A ON A.id = X.article_id JOIN tt ON tt.nature = A.source_kind GROUP BY 1, 2""")
def agg32(spark, sf_dir):
    a = articles(spark, sf_dir)
    total = a.groupBy(F.col("source_kind").alias("nature")).agg(F.count("*").alias("total"))
    rows = techniques(spark, sf_dir).join(a.select(F.col("id").alias("article_id"), F.col("source_kind").alias("nature")), "article_id").groupBy("technique", "nature").agg(F.count("*").alias("n"))
    return rows.join(total, "nature").select("technique", "nature", share(F.col("n"), F.col("total")).alias("pour_100"))


@query("agg41", f"{VIEWS} SELECT technique, count(*)::BIGINT AS n FROM X GROUP BY 1")
def agg41(spark, sf_dir):
    return techniques(spark, sf_dir).groupBy("technique").agg(F.count("*").alias("n"))


@query("agg40", f"{VIEWS} SELECT topic_key::INTEGER AS topic_key, label, coalesce(n, 0)::BIGINT AS article_count FROM T LEFT JOIN (SELECT topic_key, count(*) AS n FROM ASG WHERE portee = 'global' GROUP BY 1) USING (topic_key)")
def agg40(spark, sf_dir):
    return maintenance.refreshed_counts(topic_names(spark, sf_dir), assignments(spark, sf_dir).filter("portee = 'global'")).select("topic_key", "label", "article_count")


@query("agg42", f"{VIEWS} SELECT topic_key::INTEGER AS topic_key, label, count(*)::BIGINT AS n FROM T JOIN ASG USING (topic_key) WHERE portee = 'global' GROUP BY 1, 2 HAVING count(*) >= 11")
def agg42(spark, sf_dir):
    n = assignments(spark, sf_dir).filter("portee = 'global'").groupBy("topic_key").agg(F.count("*").alias("n")).filter("n >= 11")
    return n.join(topic_names(spark, sf_dir).select("topic_key", "label"), "topic_key")


@query("ml11", f"{VIEWS} SELECT topic_key::INTEGER AS topic_key, source_kind, sum(n_docs)::BIGINT AS n_docs FROM TS GROUP BY 1, 2")
def ml11(spark, sf_dir):
    return supports(spark, sf_dir).groupBy("topic_key", "source_kind").agg(F.sum("n_docs").alias("n_docs"))


@query("set02", f"""{VIEWS}, w AS (SELECT topic_key, list_distinct(list_transform(string_split(top_words, ','), lambda x: trim(x))) AS ws FROM T)
 SELECT a.topic_key::INTEGER AS a, b.topic_key::INTEGER AS b, round(len(list_intersect(a.ws, b.ws))::DOUBLE / len(list_distinct(list_concat(a.ws, b.ws))), 6) AS jaccard FROM w a JOIN w b ON a.topic_key < b.topic_key""")
def set02(spark, sf_dir):
    t = topic_names(spark, sf_dir).select("topic_key", "top_words")
    u = t.select(F.col("topic_key").alias("k"), F.col("top_words").alias("w"))
    return t.join(u, F.col("topic_key") < F.col("k")).select(F.col("topic_key").alias("a"), F.col("k").alias("b"), F.round(topics.keyword_jaccard(F.col("top_words"), F.col("w")), 6).alias("jaccard"))


_CENTROIDS = """m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label > 0) GROUP BY 1, 2),
 c AS (SELECT label AS topic_key, list(x ORDER BY i) AS c FROM m GROUP BY 1), e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings),
 n AS (SELECT vec_id, e.label, topic_key, list_inner_product(v, c) / ((sqrt(list_inner_product(v, v)) + 1e-9) * (sqrt(list_inner_product(c, c)) + 1e-9)) AS sim FROM e, c)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


@query("ml03", f"WITH {_CENTROIDS} SELECT vec_id, topic_key::INTEGER AS topic_key, round(sim, 6) AS sim FROM n")
def ml03(spark, sf_dir):
    s = topics.similarities(_vectors(spark, sf_dir), registry(spark, sf_dir))
    return s.select("vec_id", F.inline("sims")).select("vec_id", "topic_key", F.round("sim", 6).alias("sim"))


@query("join16", f"WITH {_CENTROIDS}, p AS (SELECT a.topic_key AS a, b.topic_key AS b, list_inner_product(a.c, b.c) / ((sqrt(list_inner_product(a.c, a.c)) + 1e-9) * (sqrt(list_inner_product(b.c, b.c)) + 1e-9)) AS sim FROM c a JOIN c b ON a.topic_key < b.topic_key) SELECT a::INTEGER AS a, b::INTEGER AS b, round(sim, 6) AS sim FROM p")
def join16(spark, sf_dir):
    r = registry(spark, sf_dir)
    s = topics.similarities(r.select(F.col("topic_key").alias("a"), F.col("centroid").alias("vec")), r)
    return s.select("a", F.inline("sims")).filter("a < topic_key").select("a", F.col("topic_key").alias("b"), F.round("sim", 6).alias("sim"))


@query("ml05", f"""WITH {_CENTROIDS}, b AS (SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE label END AS topic, max(sim) AS sim, arg_max(topic_key, sim) AS best FROM n GROUP BY 1, 2),
 f AS (SELECT quantile_cont(sim, 0.25) AS floor FROM b WHERE topic >= 0) SELECT vec_id AS id, CASE WHEN topic < 0 AND sim >= floor THEN best ELSE topic END::INTEGER AS topic_key, round(sim, 6) AS score FROM b, f""")
def ml05(spark, sf_dir):
    docs = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "vec", F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("topic"))
    return topics.reattach(docs, registry(spark, sf_dir))


_RECURSIVE = VIEWS.replace("WITH base", "WITH RECURSIVE base", 1)


@query("ml04", f"""{_RECURSIVE}, {_CENTROIDS}, sup AS (SELECT doc_id AS vec_id, CASE WHEN min(source_kind) IN ('youtube', 'tv') THEN 1 ELSE 2 END AS support FROM A GROUP BY 1),
 comp AS (SELECT (label * 10 + coalesce(support, 0))::INTEGER AS i, unnest(range(1, len(embedding) + 1)) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings LEFT JOIN sup USING (vec_id) WHERE label > 0),
 new AS (SELECT i, list(v ORDER BY p) AS v FROM (SELECT i, p, avg(v) AS v FROM comp GROUP BY 1, 2) GROUP BY 1),
 pairs AS (SELECT i, topic_key::INTEGER AS topic_key, sim, row_number() OVER (ORDER BY sim DESC, i, topic_key) AS r FROM (SELECT i, topic_key, list_inner_product(v, c) / ((sqrt(list_inner_product(v, v)) + 1e-9) * (sqrt(list_inner_product(c, c)) + 1e-9)) AS sim FROM new, c) WHERE sim >= 0.62),
 walk AS (SELECT 0::BIGINT AS r, []::INTEGER[] AS used_i, []::INTEGER[] AS used_k, false AS picked UNION ALL SELECT r, CASE WHEN free THEN list_append(used_i, i) ELSE used_i END, CASE WHEN free THEN list_append(used_k, topic_key) ELSE used_k END, free FROM (SELECT pairs.r, used_i, used_k, i, topic_key, NOT list_contains(used_i, i) AND NOT list_contains(used_k, topic_key) AS free FROM walk JOIN pairs ON pairs.r = walk.r + 1))
 SELECT 'global' AS scope, i, topic_key, round(sim, 6) AS sim FROM walk JOIN pairs USING (r) WHERE picked""")
def ml04(spark, sf_dir):
    """Centroids of all labelled vectors by label and support (video, text, no document), matched one to one with the registry."""
    support = articles(spark, sf_dir).groupBy(F.col("doc_id").alias("vec_id")).agg(F.when(F.min("source_kind").isin("youtube", "tv"), 1).otherwise(2).alias("support"))
    place = F.coalesce("support", F.lit(0))
    x = _vectors(spark, sf_dir).filter("label > 0").join(support, "vec_id", "left").select((F.col("label") * 10 + place).cast("int").alias("i"), F.posexplode("vec").alias("p", "x")).groupBy("i", "p").agg(F.avg("x").alias("x"))
    new = x.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("c")).select(F.lit("global").alias("scope"), "i", F.transform("c", lambda s: s["x"]).alias("centroid"))
    return topics.greedy_match(new, registry(spark, sf_dir).withColumn("portee", F.lit("global")), 0.62).withColumn("sim", F.round("sim", 6))


def _assigned(spark, sf_dir):
    a = assignments(spark, sf_dir).filter("portee = 'global'").select("article_id", F.col("topic_key").alias("topic"))
    return a.join(articles(spark, sf_dir).select(F.col("id").alias("article_id"), F.col("source_kind").alias("kind"), corpus.parent().alias("parent")), "article_id")


@query("ml09", f"""{VIEWS}, r AS (SELECT ASG.topic_key AS topic, A.source_kind AS kind, {PARENT} AS parent FROM ASG JOIN A ON A.id = ASG.article_id WHERE ASG.portee = 'global'),
 k AS (SELECT topic, kind, count(*) AS n FROM r WHERE topic >= 0 GROUP BY 1, 2), p AS (SELECT topic, count(DISTINCT parent) AS parents FROM r WHERE topic >= 0 GROUP BY 1), tt AS (SELECT topic, sum(n) AS n, max(n) AS top, any_value(parents) AS parents FROM k JOIN p USING (topic) GROUP BY 1),
 st AS (SELECT count(*)::BIGINT AS themes, round(max(n) / sum(n)::DOUBLE, 6) AS dominant, round(1 - sum(n) / (SELECT count(*) FROM r)::DOUBLE, 6) AS non_classe, round(sum(top) / sum(n)::DOUBLE, 6) AS purete_media, round(count(*) FILTER (parents = 1) / count(*)::DOUBLE, 6) AS mono_parent FROM tt) SELECT *, round(dominant + non_classe + mono_parent, 6) AS score FROM st""")
def ml09(spark, sf_dir):
    return topics.structure(_assigned(spark, sf_dir))


@query("ml07", f"""{VIEWS} SELECT ASG.portee, count(*)::BIGINT AS docs, count(DISTINCT {PARENT})::BIGINT AS parents, count(*) >= 40 AND count(DISTINCT {PARENT}) >= 5 AS enough FROM ASG JOIN A ON A.id = ASG.article_id GROUP BY 1""")
def ml07(spark, sf_dir):
    a = assignments(spark, sf_dir).select("article_id", "portee").join(articles(spark, sf_dir).select(F.col("id").alias("article_id"), corpus.parent().alias("parent")), "article_id")
    return topics.enough(a)


@query("ml02")
def ml02(spark, sf_dir):
    """k-means in place of density clustering, small clusters as noise: size of each."""
    v = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "vec")
    return topics.cluster(v, 10, least=topics.minimum_cluster(v.count())).groupBy("topic").agg(F.count("*").alias("n"))


def _settings(spark, scope, n):
    least = topics.minimum_cluster(n)
    return spark.createDataFrame([(scope, f"{m}-{k}", k, m) for k in sorted({max(2, least // 2), least, least + 5}) for m in ("leaf", "eom")], "scope string, setting string, least int, method string")


def _points(spark, sf_dir):
    return _vectors(spark, sf_dir).select(F.lit("all").alias("scope"), F.col("vec_id").alias("id"), "vec")


# Prim's algorithm as a recursion: open holds the least link of each document that isn't in the tree yet, null for the others.
@query("ml02_tree", """WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS i, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT greatest(4, least(15, count(*) // 25)) AS k FROM embeddings),
 d AS MATERIALIZED (SELECT a.i, b.i AS j, list_distance(a.v, b.v) AS d FROM e a CROSS JOIN e b), c AS MATERIALIZED (SELECT i, list_sort(list(d) FILTER (i <> j))[least(k, count(*) - 1)] AS core FROM d CROSS JOIN p GROUP BY i, k),
 m AS MATERIALIZED (SELECT d.i, list(greatest(d.d, a.core, b.core) ORDER BY j) AS reach FROM d JOIN c a ON a.i = d.i JOIN c b ON b.i = d.j GROUP BY d.i),
 r AS (SELECT NULL::DOUBLE AS weight, list_transform(reach, lambda x, k: CASE WHEN k > 1 THEN x END) AS open FROM m WHERE i = 1
  UNION ALL SELECT weight, list_transform(list_zip(open, reach), lambda x, k: CASE WHEN x[1] IS NOT NULL AND k <> next THEN least(x[1], x[2]) END) AS open FROM (SELECT open, list_min(open) AS weight, list_position(open, list_min(open)) AS next FROM r WHERE list_min(open) IS NOT NULL) JOIN m ON m.i = next)
 SELECT round(weight, 6) AS weight FROM r WHERE weight IS NOT NULL""")
def ml02_tree(spark, sf_dir):
    """Links of the spanning tree of mutual reachability over all vectors."""
    docs = _points(spark, sf_dir)
    near = spark.createDataFrame([("all", topics.minimum_cluster(docs.count()))], "scope string, samples int")
    return density.density_tree(docs, near).select(F.round("weight", 6).alias("weight"))


@query("ml02_density")
def ml02_density(spark, sf_dir):
    """Sizes of density clusters under the settings of a grid, from one tree."""
    docs = _points(spark, sf_dir)
    settings = _settings(spark, "all", docs.count())
    return density.density_clusters(docs, settings).groupBy("setting", "topic").agg(F.count("*").alias("n"))


@query("ml09_grid")
def ml09_grid(spark, sf_dir):
    """The settings of the grid judged at once, over the vectors that belong to articles."""
    rows = articles(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source_kind").alias("kind"), corpus.parent().alias("parent"))
    docs = settled(_points(spark, sf_dir).join(rows.select("id"), "id", "left_semi"), "docs")
    return density.grid(density.density_clusters(docs, _settings(spark, "all", docs.count())), rows)


@query("ml07_fallback", f"""{VIEWS}, r AS (SELECT portee, run_date AS day, {PARENT} AS parent FROM ASG JOIN A ON A.id = ASG.article_id WHERE run_date IS NOT NULL),
 o AS (SELECT portee, day, count(*)::BIGINT AS docs, count(DISTINCT parent)::BIGINT AS parents FROM r GROUP BY ALL),
 w AS (SELECT o.portee, o.day, count(*)::BIGINT AS wide_docs, count(DISTINCT parent)::BIGINT AS wide_parents FROM o JOIN r ON r.portee = o.portee AND r.day BETWEEN o.day - 6 AND o.day GROUP BY ALL)
 SELECT portee, strftime(day, '%Y-%m-%d') AS day, docs, parents, wide_docs, wide_parents, CASE WHEN docs >= 12 AND parents >= 5 THEN 'day' WHEN wide_docs >= 12 AND wide_parents >= 5 THEN 'week' ELSE 'noise' END AS takes FROM o JOIN w USING (portee, day)""")
def ml07_fallback(spark, sf_dir):
    """What each scope's day is clustered from: itself, the last seven days, or nothing."""
    a = assignments(spark, sf_dir).select("article_id", "portee", F.col("run_date").alias("day")).join(articles(spark, sf_dir).select(F.col("id").alias("article_id"), corpus.parent().alias("parent")), "article_id")
    return topics.volumes(a, docs=12).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("txt13_draw", f"""{VIEWS}, ta AS (SELECT topic_key, article_id, sha256(article_id) AS h FROM ASG WHERE portee = 'global' AND topic_key >= 0),
 fa AS (SELECT topic_key, article_id, row_number() OVER (PARTITION BY topic_key ORDER BY article_id) AS r FROM ta), na AS (SELECT article_id, row_number() OVER (ORDER BY topic_key, h, article_id) - 1 AS number FROM ta),
 za AS (SELECT topic_key, count(*) AS size, sum(count(*)) OVER (ORDER BY topic_key) - count(*) AS start, sum(count(*)) OVER () AS all_n FROM ta GROUP BY 1),
 qa AS (SELECT topic_key, k + 1 AS rank, (start + size + (('0x' || left(sha256(topic_key || ':42'), 8))::BIGINT + k * ((all_n - size) // 6)) % (all_n - size)) % all_n AS number FROM za, range(6) t(k) WHERE size >= 11 AND all_n - size >= 6)
 SELECT topic_key::INTEGER AS topic_key, CASE WHEN r <= 5 THEN 'member' ELSE 'test' END AS role, (CASE WHEN r <= 5 THEN r ELSE r - 5 END)::INTEGER AS rank, article_id FROM fa JOIN za USING (topic_key) WHERE r <= 11 AND size >= 11
 UNION ALL SELECT topic_key::INTEGER, 'stranger', rank::INTEGER, article_id FROM qa JOIN na USING (number)""")
def txt13_draw(spark, sf_dir):
    """The members, tests and strangers of every topic."""
    return topics.drawn(assignments(spark, sf_dir).filter("portee = 'global'"))


@query("ml08", f"{VIEWS} SELECT portee, count(*)::BIGINT AS n, greatest(4, least(15, count(*) // 25))::BIGINT AS least, greatest(2, least(10, count(*) - 1))::BIGINT AS near FROM ASG GROUP BY 1")
def ml08(spark, sf_dir):
    """The least cluster and the neighbours that each scope's number of documents calls for."""
    return topics.cluster_settings(assignments(spark, sf_dir))


@query("ml06", f"""{VIEWS}, r AS (SELECT *, topic_key % 3 <> 0 AS hit, topic_key % 3 <> 0 AND topic_key % 2 = 1 AS changed FROM T), fresh AS (SELECT (SELECT max(topic_key) FROM T) + row_number() OVER (ORDER BY topic_key) AS topic_key FROM T WHERE topic_key % 3 = 0)
 SELECT topic_key::INTEGER AS topic_key, CASE WHEN changed THEN 'new label' ELSE label END AS label, CASE WHEN changed THEN 'other, words' ELSE top_words END AS top_words, CASE WHEN hit THEN 15 ELSE 10 END::BIGINT AS article_count, '2024-01-01' AS first_seen, CASE WHEN hit THEN '{AS_OF}' ELSE '2024-01-20' END AS last_seen, hit AS active FROM r
 UNION ALL SELECT topic_key::INTEGER, 'fresh', 'fresh, words', 7, '{AS_OF}', '{AS_OF}', true FROM fresh""")
def ml06(spark, sf_dir):
    """The registry after a day on which two thirds of its topics came back, some with other words, and as many clusters as the rest were new."""
    old = registry(spark, sf_dir).select("topic_key", "label", "top_words", "centroid", F.lit(10).cast("long").alias("article_count"), F.lit("2024-01-01").cast("date").alias("first_seen"), F.lit("2024-01-20").cast("date").alias("last_seen"), "active", F.lit("global").alias("portee"))
    words = F.when(F.col("topic_key") % 2 == 1, "other, words").otherwise(F.col("top_words"))
    back = old.filter("topic_key % 3 <> 0").select(F.lit("global").alias("scope"), F.col("topic_key").alias("i"), "centroid", F.lit("new label").alias("label"), words.alias("top_words"), F.lit(5).alias("n"))
    fresh = old.filter("topic_key % 3 = 0").select(F.lit("global").alias("scope"), F.col("topic_key").alias("i"), F.transform("centroid", lambda x: -x).alias("centroid"), F.lit("fresh").alias("label"), F.lit("fresh, words").alias("top_words"), F.lit(7).alias("n"))
    new = back.unionByName(fresh)
    out = topics.update_registry(old, new, topics.greedy_match(new, old, 0.62), AS_OF)
    return out.select("topic_key", "label", "top_words", "article_count", _D("first_seen"), _D("last_seen"), "active")


@query("set04", f"{VIEWS} SELECT topic_key::INTEGER AS topic_key FROM T WHERE active AND topic_key NOT IN (SELECT topic_key FROM ASG WHERE portee = 'global' AND run_date = DATE '2024-01-31')")
def set04(spark, sf_dir):
    return topics.newly_dormant(topic_names(spark, sf_dir), assignments(spark, sf_dir).filter("portee = 'global' AND run_date = DATE'2024-01-31'"))


@query("join03", f"{VIEWS} SELECT T.label, A.type_media, count(*)::BIGINT AS n FROM T JOIN ASG ON T.topic_key = ASG.topic_key JOIN A ON A.id = ASG.article_id WHERE ASG.portee = 'global' AND T.active GROUP BY ALL")
def join03(spark, sf_dir):
    a = assignments(spark, sf_dir).filter("portee = 'global'").select("article_id", "topic_key").join(topic_names(spark, sf_dir).filter("active").select("topic_key", "label"), "topic_key")
    return a.join(articles(spark, sf_dir), F.col("article_id") == F.col("id")).groupBy("label", "type_media").agg(F.count("*").alias("n"))


@query("ml_filter_window", f"{VIEWS} SELECT source_kind, count(*)::BIGINT AS n FROM A WHERE published_at >= TIMESTAMP '2024-01-25' AND published_at < TIMESTAMP '2024-02-01' GROUP BY 1")
def ml_filter_window(spark, sf_dir):
    """The seven-day window that a thin day is widened to."""
    return articles(spark, sf_dir).filter(filters.article_filter("2024-01-25", AS_OF)).groupBy("source_kind").agg(F.count("*").alias("n"))
