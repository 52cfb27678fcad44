"""Topic reporting, registry matching and lifecycle, outliers, clustering metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions.columns import share

NOISE = -1


def sizes(topics: DataFrame, assigned: DataFrame, articles: DataFrame, kept: Column, scope: str = "global") -> DataFrame:
    """topic_key, label, top_words, active, n, pct: topics by size. A topic all of whose documents are filtered out isn't listed; one without any document is."""
    a = assigned.filter(F.col("portee") == scope).select("topic_key", "article_id")
    rows = topics.join(a, "topic_key", "left").join(articles, F.col("article_id") == F.col("id"), "left").filter(F.col("id").isNull() | kept)
    n = rows.groupBy("topic_key", "label", "top_words", "active").agg(F.count("id").alias("n"))
    total = n.agg(F.sum("n").alias("all_n"))
    return n.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100.0 * F.col("n").cast("double") / F.nullif(F.col("all_n"), F.lit(0)), 1)).drop("all_n")


def daily_shares(assigned: DataFrame, topics: DataFrame, scope: str, most: int = 15) -> DataFrame:
    """jour, theme, n, part of the day's documents, for the largest topics."""
    rows = assigned.filter((F.col("portee") == scope) & F.col("run_date").isNotNull() & (F.col("topic_key") >= 0))
    n = rows.groupBy(F.col("run_date").alias("jour"), "topic_key").agg(F.count("*").alias("n"))
    day = n.groupBy("jour").agg(F.sum("n").alias("day_n"))
    top = n.groupBy("topic_key").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "topic_key").limit(most).select("topic_key")
    return n.join(F.broadcast(top), "topic_key").join(day, "jour").join(topics, "topic_key").select("jour", F.col("label").alias("theme"), "n", share(F.col("n"), F.col("day_n")).alias("part"))


def period_themes(assigned: DataFrame, topics: DataFrame, supports: DataFrame, first: str, last: str, scope: str = "global") -> DataFrame:
    """theme, n, supports (kinds, sorted, joined by +)."""
    within = F.col("run_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    n = assigned.filter(within & (F.col("portee") == scope) & (F.col("topic_key") >= 0)).groupBy("topic_key").agg(F.count("*").alias("n"))
    kinds = supports.filter(within).groupBy("topic_key").agg(F.array_join(F.sort_array(F.collect_set("source_kind")), "+").alias("supports"))
    return n.join(topics, "topic_key").join(kinds, "topic_key", "left").select(F.col("label").alias("theme"), "n", F.coalesce("supports", F.lit("")).alias("supports"))


def classified(assigned: DataFrame, first: str, last: str, scope: str = "global") -> DataFrame:
    within = F.col("run_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return assigned.filter(within & (F.col("portee") == scope)).agg(F.count_if(F.col("topic_key") >= 0).alias("n_classified"), F.count("*").alias("n_total"))


def support_breakdown(supports: DataFrame, topics: DataFrame, first: str, last: str) -> DataFrame:
    """theme, support, n_docs, top_words, n_supports."""
    within = supports.filter(F.col("run_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    by = within.groupBy("topic_key", F.col("source_kind").alias("support")).agg(F.sum("n_docs").alias("n_docs"), F.min("top_words").alias("top_words"))
    wide = by.groupBy("topic_key").agg(F.count("*").alias("n_supports"))
    return by.join(wide, "topic_key").join(topics.select("topic_key", F.col("label").alias("theme")), "topic_key").select("theme", "support", "n_docs", "top_words", "n_supports")


def latest_quality(quality: DataFrame, topics: DataFrame, weak: float = 0.5) -> DataFrame:
    """The last run's judgements, each with whether it is weak."""
    last = quality.agg(F.max("run_date").alias("run_date"))
    rows = quality.join(F.broadcast(last), "run_date").join(topics.select("topic_key", "label"), "topic_key")
    return rows.select("topic_key", "label", "categorie", F.round("coherence", 6).alias("coherence"), F.round("distinction", 6).alias("distinction"), ((F.col("coherence") < weak) | (F.col("distinction") < weak)).alias("weak"))


def drifted(assigned: DataFrame, topics: DataFrame, now: tuple[str, str], before: tuple[str, str], scope: str = "global") -> DataFrame:
    """theme, part, was, ecart, state: shares of a period's themes against the period before; those new have no ecart, those gone no part.

    Both periods (first and last day) are counted in one pass, and totals follow
    from the counts: a row a topic, of which a scope has some thousands at most.
    """
    within = lambda span: F.col("run_date").between(*[F.lit(d).cast("date") for d in span])
    rows = assigned.filter((F.col("portee") == scope) & (F.col("topic_key") >= 0) & (within(now) | within(before)))
    n = rows.groupBy("topic_key").agg(F.count_if(within(now)).alias("a"), F.count_if(within(before)).alias("b"))
    named = n.join(topics.select("topic_key", F.col("label").alias("theme")), "topic_key")
    every = named.agg(F.collect_list(F.struct("theme", "a", "b")).alias("rows"), F.sum("a").alias("all_a"), F.sum("b").alias("all_b")).select(F.inline("rows"), "all_a", "all_b")
    part = lambda c: F.when(F.col(c) > 0, share(F.col(c), F.col(f"all_{c}")))
    state = F.when(F.col("b") == 0, "new").when(F.col("a") == 0, "gone").otherwise("kept")
    return every.select("theme", part("a").alias("part"), part("b").alias("was"), F.round(part("a") - part("b"), 6).alias("ecart"), state.alias("state"))


def keyword_jaccard(a: Column, b: Column, first: int = 10) -> Column:
    """Of the first keywords of two comma-separated lists; 0 if either is empty."""
    words = lambda c: F.filter(F.transform(F.slice(F.split(F.coalesce(c, F.lit("")), ","), 1, first), lambda w: F.trim(w)), lambda w: w != "")
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))


def similarities(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """docs with sims: an array of (sim, topic_key) against every topic of the registry.

    The registry is small by nature (a row for each live topic); it travels as one
    array, so that rows are neither multiplied nor shuffled.
    """
    registry = topics.filter(F.size("centroid") > 0).agg(F.sort_array(F.collect_list(F.struct("topic_key", "centroid"))).alias("registry"))
    return docs.crossJoin(F.broadcast(registry)).withColumn("sims", F.transform("registry", lambda t: F.struct(cosine(F.col("vec"), t["centroid"]).alias("sim"), t["topic_key"].alias("topic_key")))).drop("registry")


def reattach(docs: DataFrame, topics: DataFrame, quartile: float = 0.25) -> DataFrame:
    """id, topic_key, score: noise joins its nearest topic if it is as near as the classified documents' lower quartile."""
    near = similarities(docs, topics).withColumn("best", F.reduce("sims", F.struct(F.lit(-2.0).alias("sim"), F.lit(NOISE).alias("topic_key")), lambda a, x: F.when(x["sim"] > a["sim"], x).otherwise(a)))
    floor = near.filter(F.col("topic") >= 0).agg(F.percentile(F.col("best.sim"), quartile).alias("floor"))
    rows = near.crossJoin(F.broadcast(floor))
    joins = (F.col("topic") < 0) & (F.col("best.sim") >= F.col("floor"))
    return rows.select("id", F.when(joins, F.col("best.topic_key")).otherwise(F.col("topic")).alias("topic_key"), F.round(F.col("best.sim"), 6).alias("score"))


def greedy_match(new: DataFrame, registry: DataFrame, threshold: float) -> DataFrame:
    """scope, i, topic_key, sim: one-to-one matches of new clusters (scope, i, centroid) with registry topics, most similar first.

    Pairs above the threshold are found in Spark; only those of one scope, a few
    dozen clusters' worth, meet in a task that picks them in order.
    """
    pairs = new.join(registry.select(F.col("portee").alias("scope"), "topic_key", F.col("centroid").alias("known")), "scope").withColumn("sim", cosine(F.col("centroid"), F.col("known"))).filter(F.col("sim") >= threshold).select("scope", "i", "topic_key", "sim")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        used_i, used_k, out = set(), set(), []
        for r in pdf.sort_values(["sim", "i", "topic_key"], ascending=[False, True, True]).itertuples(index=False):
            if r.i not in used_i and r.topic_key not in used_k:
                used_i.add(r.i)
                used_k.add(r.topic_key)
                out.append(r)
        return pd.DataFrame(out, columns=list(pdf.columns))

    return pairs.groupBy("scope").applyInPandas(pick, "scope string, i int, topic_key int, sim double")


def update_registry(registry: DataFrame, new: DataFrame, matches: DataFrame, day: str, *, scope: str = "global", keep_label: float = 0.4, dormant_days: int = 7) -> DataFrame:
    """The next snapshot of the registry.

    new: scope, i, centroid, label, top_words, n. A matched topic takes the
    cluster's centroid, words and day; its label stays unless the keywords
    changed too much. An unmatched cluster gets the next key. Topics unseen for
    dormant_days become inactive, those matched active again.
    """
    today = F.lit(day).cast("date")
    m = matches.filter(F.col("scope") == scope).select("i", "topic_key").join(new.filter(F.col("scope") == scope), "i")
    m = m.select("topic_key", F.col("centroid").alias("c"), F.col("label").alias("l"), F.col("top_words").alias("w"), F.col("n").alias("k"))
    old = registry.join(m, "topic_key", "left")
    hit = F.col("c").isNotNull()
    same = keyword_jaccard(F.col("top_words"), F.col("w")) >= keep_label
    seen = F.when(hit, today).otherwise(F.col("last_seen"))
    old = old.select(
        "topic_key", F.when(hit & ~same, F.col("l")).otherwise(F.col("label")).alias("label"), F.when(hit, F.col("w")).otherwise(F.col("top_words")).alias("top_words"), F.when(hit, F.col("c")).otherwise(F.col("centroid")).alias("centroid"),
        (F.coalesce("article_count", F.lit(0)) + F.coalesce("k", F.lit(0))).alias("article_count"), "first_seen", seen.alias("last_seen"), (seen >= F.date_sub(today, dormant_days)).alias("active"), "portee",
    )
    top = registry.agg(F.coalesce(F.max("topic_key"), F.lit(0)).alias("top"))
    fresh = new.filter(F.col("scope") == scope).join(matches.filter(F.col("scope") == scope).select("i"), "i", "left_anti").crossJoin(F.broadcast(top))
    key = (F.col("top") + F.row_number().over(Window.partitionBy("scope").orderBy("i"))).cast("int")
    fresh = fresh.select(key.alias("topic_key"), "label", "top_words", "centroid", F.col("n").cast("long").alias("article_count"), today.alias("first_seen"), today.alias("last_seen"), F.lit(True).alias("active"), F.col("scope").alias("portee"))
    return old.unionByName(fresh)


def newly_dormant(before: DataFrame, matched: DataFrame) -> DataFrame:
    return before.filter("active").select("topic_key").join(matched.select("topic_key"), "topic_key", "left_anti")


def structure(rows: DataFrame) -> DataFrame:
    """themes, dominant, non_classe, purete_media, mono_parent, score of an assignment (topic, kind, parent): what a grid of settings is judged by."""
    by = rows.filter(F.col("topic") >= 0).groupBy("topic", "kind").agg(F.count("*").alias("n"))
    parents = rows.filter(F.col("topic") >= 0).groupBy("topic").agg(F.countDistinct("parent").alias("parents"))
    topic = by.groupBy("topic").agg(F.sum("n").alias("n"), F.max("n").alias("top")).join(parents, "topic")
    t = topic.agg(F.count("*").alias("themes"), F.max("n").alias("largest"), F.sum("n").alias("c"), F.sum("top").alias("pure"), F.count_if(F.col("parents") == 1).alias("mono"))
    total = rows.agg(F.count("*").alias("all_n"))
    part = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)).cast("double"), 6)
    out = t.crossJoin(F.broadcast(total)).select("themes", part("largest", "c").alias("dominant"), F.round(1 - F.col("c") / F.col("all_n").cast("double"), 6).alias("non_classe"), part("pure", "c").alias("purete_media"), part("mono", "themes").alias("mono_parent"))
    return out.withColumn("score", F.round(F.col("dominant") + F.col("non_classe") + F.col("mono_parent"), 6))


def minimum_cluster(n: int) -> int:
    """The least cluster of a day with n documents."""
    return max(4, min(15, n // 25))


def neighbours(n: int) -> int:
    return max(2, min(10, n - 1))


def cluster_settings(rows: DataFrame) -> DataFrame:
    """portee, n, least, near: minimum_cluster and neighbours of each scope."""
    n = rows.groupBy("portee").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(4), F.least(F.lit(15), F.floor(F.col("n") / 25)))
    return n.select("portee", "n", least.cast("long").alias("least"), F.greatest(F.lit(2), F.least(F.lit(10), F.col("n") - 1)).cast("long").alias("near"))


#: What a snapshot of the registry holds.
REGISTRY = "topic_key int, label string, top_words string, centroid array<double>, article_count long, first_seen date, last_seen date, active boolean, portee string"


def enough(rows: DataFrame, docs: int = 40, parents: int = 5) -> DataFrame:
    """Per scope, whether a day has documents and parents enough to be clustered by itself."""
    n = rows.groupBy("portee").agg(F.count("*").alias("docs"), F.countDistinct("parent").alias("parents"))
    return n.withColumn("enough", (F.col("docs") >= docs) & (F.col("parents") >= parents))


def volumes(rows: DataFrame, docs: int = 40, parents: int = 5, days: int = 7) -> DataFrame:
    """portee, day, docs, parents, wide_docs, wide_parents, takes: what each scope's day is clustered from.

    rows: portee, day, parent of every document. `day` if the day has documents
    and parents enough by itself; else `week` if the last `days` days up to it
    have; else `noise`: its documents stay unclassified. Documents are counted by
    parent and day first; each such row then counts for the days whose window it is in.
    """
    by = rows.filter(F.col("day").isNotNull() & F.col("portee").isNotNull()).groupBy("portee", "day", "parent").agg(F.count("*").alias("n"))
    own = by.groupBy("portee", "day").agg(F.sum("n").alias("docs"), F.count("parent").alias("parents"))
    spread = by.withColumn("day", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_add("day", k.cast("int")))))
    wide = spread.groupBy("portee", "day", "parent").agg(F.sum("n").alias("n")).groupBy("portee", "day").agg(F.sum("n").alias("wide_docs"), F.count("parent").alias("wide_parents"))
    enough = lambda n, p: (F.col(n) >= docs) & (F.col(p) >= parents)
    takes = F.when(enough("docs", "parents"), "day").when(enough("wide_docs", "wide_parents"), "week").otherwise("noise")
    return own.join(wide, ["portee", "day"]).withColumn("takes", takes)


def taken(rows: DataFrame, decided: DataFrame, days: int = 7) -> DataFrame:
    """portee, of (the day that is clustered), own (whether of that day) and the columns of rows: the documents that each scope's day is clustered from; those of `noise` days are not among them.

    decided: of volumes, a row for each scope and day.
    """
    spread = rows.withColumn("of", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_add("day", k.cast("int")))))
    own = F.col("of") == F.col("day")
    d = decided.select("portee", F.col("day").alias("of"), "takes")
    return spread.join(d, ["portee", "of"]).filter((own & (F.col("takes") == "day")) | (F.col("takes") == "week")).withColumn("own", own).drop("takes")


def drawn(assigned: DataFrame, members: int = 5, tests: int = 6, strangers: int = 6, seed: int = 42) -> DataFrame:
    """topic_key, role (member, test, stranger), rank, article_id: the documents by which each topic is judged.

    assigned: topic_key, article_id, probability. Members and tests are the most
    probable documents (ties by id) of topics that have enough of both. Strangers
    are documents of other topics: all are numbered by topic and then by the hash
    of their id, and a topic takes every so manieth number outside its own from
    one that its key's hash says, so the draw is the same however rows lie. Only
    a hundredth or so of a topic's documents meet in one task; noise isn't drawn.
    """
    rows = assigned.filter(F.col("topic_key") >= 0).select("topic_key", "article_id", "probability", F.sha2(F.col("article_id").cast("string"), 256).alias("hash"))
    rows = rows.withColumn("bucket", F.substring("hash", 1, 2))
    # the most probable of each bucket first, then of the topic
    top = lambda by, rank: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("probability"), "article_id")).alias(rank)
    few = rows.select("*", top(["topic_key", "bucket"], "r")).filter(F.col("r") <= members + tests).drop("r")
    first = few.select("topic_key", "article_id", top(["topic_key"], "rank")).filter(F.col("rank") <= members + tests)
    sizes = rows.groupBy("topic_key", "bucket").agg(F.count("*").alias("n"))
    # rows for each topic and bucket, and for each topic: small tables
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("topic_key", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    of = base.groupBy("topic_key").agg(F.sum("n").alias("size"), F.min("base").alias("start"))
    of = of.crossJoin(F.broadcast(of.agg(F.sum("size").alias("all_n")))).filter(F.col("size") >= members + tests)
    outside = F.col("all_n") - F.col("size")
    at = F.conv(F.substring(F.sha2(F.concat("topic_key", F.lit(f":{seed}")), 256), 1, 8), 16, 10).cast("long")
    k = F.explode(F.sequence(F.lit(0), F.lit(strangers - 1)))
    asked = of.filter(outside >= strangers).select("*", outside.alias("outside"), at.alias("at"), k.alias("k"))
    asked = asked.select("topic_key", (F.col("k") + 1).alias("rank"), F.expr("(start + size + (at + k * (outside div " + str(strangers) + ")) % outside) % all_n").alias("number"))
    numbered = rows.join(F.broadcast(base.select("topic_key", "bucket", "base")), ["topic_key", "bucket"])
    numbered = numbered.select("article_id", (F.col("base") + F.row_number().over(Window.partitionBy("topic_key", "bucket").orderBy("hash", "article_id")) - 1).alias("number"))
    other = numbered.join(F.broadcast(asked), "number").select("topic_key", F.lit("stranger").alias("role"), "rank", "article_id")
    own = first.join(F.broadcast(of.select("topic_key")), "topic_key").select("topic_key", F.when(F.col("rank") <= members, "member").otherwise("test").alias("role"), F.when(F.col("rank") <= members, F.col("rank")).otherwise(F.col("rank") - members).alias("rank"), "article_id")
    return own.unionByName(other)


def cluster(docs: DataFrame, k: int, seed: int = 42, least: int | None = None) -> DataFrame:
    """id, topic: k-means over vectors; clusters below the least size become noise. A plain way beside operators.density."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = docs.withColumn("features", array_to_vector(F.transform("vec", lambda v: v.cast("double"))))
    out = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="topic").fit(x).transform(x).select("id", "topic")
    small = out.groupBy("topic").agg(F.count("*").alias("n")).filter(F.col("n") < (least or 4)).select("topic", F.lit(1).alias("small"))
    return out.join(F.broadcast(small), "topic", "left").select("id", F.when(F.col("small") == 1, NOISE).otherwise(F.col("topic")).alias("topic"))


def representative(assigned: DataFrame, most: int = 11) -> DataFrame:
    """The most probable members of every topic at once."""
    rank = F.row_number().over(Window.partitionBy("topic_key").orderBy(F.desc("probability"), "article_id"))
    return assigned.filter("topic_key >= 0").withColumn("rank", rank).filter(F.col("rank") <= most)


def page_of(topics: DataFrame, page: int, size: int = 20) -> DataFrame:
    """A page of topics by size; the rank is over a row for each topic."""
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "topic_key"))
    return topics.withColumn("rank", rank).filter(F.col("rank").between(page * size + 1, (page + 1) * size))
