from pressloom.operators import topics, weights

V = "array<double>"


def test_greedy_match(spark):
    new = spark.createDataFrame([("g", 0, [1.0, 0.0]), ("g", 1, [0.9, 0.1]), ("g", 2, [-1.0, 0.0])], f"scope string, i int, centroid {V}")
    old = spark.createDataFrame([(1, [1.0, 0.0], "g"), (2, [0.8, 0.3], "g"), (3, [0.0, -1.0], "g")], f"topic_key int, centroid {V}, portee string")
    got = {r["i"]: r["topic_key"] for r in topics.greedy_match(new, old, 0.62).collect()}
    assert got == {0: 1, 1: 2}
    assert topics.greedy_match(new, old.limit(0), 0.62).count() == 0
    tie = spark.createDataFrame([("g", 0, [1.0, 0.0]), ("g", 1, [1.0, 0.0])], f"scope string, i int, centroid {V}")
    assert {r["i"]: r["topic_key"] for r in topics.greedy_match(tie, old.filter("topic_key = 1"), 0.5).collect()} == {0: 1}


def test_registry_lifecycle(spark):
    from pyspark.sql import functions as F

    old = spark.createDataFrame([(1, "one", "a, b", [1.0, 0.0], 5, "2024-01-01", "2024-01-30", True, "g"), (2, "two", "c, d", [0.0, 1.0], 5, "2024-01-01", "2024-01-10", True, "g"), (3, "three", "e, f", [1.0, 1.0], 5, "2024-01-01", "2024-01-02", False, "g")], f"topic_key int, label string, top_words string, centroid {V}, article_count long, first_seen string, last_seen string, active boolean, portee string")
    old = old.withColumn("first_seen", F.to_date("first_seen")).withColumn("last_seen", F.to_date("last_seen"))
    new = spark.createDataFrame([("g", 0, [1.0, 0.0], "ONE", "a, x, y, z", 3), ("g", 1, [1.0, 1.0], "THREE", "e, f", 2), ("g", 2, [-1.0, 0.0], "new", "n", 4)], f"scope string, i int, centroid {V}, label string, top_words string, n int")
    matches = topics.greedy_match(new, old, 0.9)
    got = {r["topic_key"]: r for r in topics.update_registry(old, new, matches, "2024-01-31", scope="g").collect()}
    assert got[1]["label"] == "ONE" and got[1]["article_count"] == 8 and got[1]["active"]
    assert got[3]["label"] == "three" and got[3]["active"]
    assert not got[2]["active"] and got[4]["label"] == "new" and str(got[4]["first_seen"]) == "2024-01-31"
    assert [r["topic_key"] for r in topics.newly_dormant(old, matches).collect()] == [2]


def test_reattach_edges(spark):
    reg = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], f"topic_key int, centroid {V}")
    docs = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.8, 0.6], 1), (3, [0.9, 0.1], -1), (4, [-1.0, -1.0], -1)], f"id int, vec {V}, topic int")
    assert {r["id"]: r["topic_key"] for r in topics.reattach(docs, reg).collect()} == {1: 1, 2: 1, 3: 1, 4: -1}
    none = topics.reattach(docs.filter("topic < 0"), reg)
    assert {r["topic_key"] for r in none.collect()} == {-1}


def test_jaccard_edges(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a, b", ""), ("a, b", "b, a"), ("a, b, c, d", "a, b, e")], "x string, y string")
    assert [round(r[0], 4) for r in df.select(topics.keyword_jaccard(F.col("x"), F.col("y"))).collect()] == [0.0, 1.0, 0.4]


def test_sizes_of_clusters():
    assert [topics.minimum_cluster(n) for n in (10, 200, 1000)] == [4, 8, 15] and [topics.neighbours(n) for n in (2, 8, 50)] == [2, 7, 10]


def test_weights_sum_to_strata(spark):
    rows = [("s1", "etat")] * 10 + [("s2", "etat")] * 3 + [("s3", "exil")] * 5 + [("s4", None)] * 2
    df = spark.createDataFrame(rows, "source_name string, type_media string")
    total = lambda scheme: round(weights.weighted(df, scheme).agg({"w": "sum"}).first()[0], 9)
    assert [total(s) for s in ("raw", "source", "family", "block", "family_source")] == [20, 4, 3, 2, 3]
    n = weights.denominators(weights.weighted(df.withColumn("content", df["source_name"]), "raw")).first()["n_eff"]
    assert n == 20


def test_all_labelled_vectors_are_matched(spark, tmp_path):
    """Topics whose vectors all have odd ids, with a document of either support or none, are matched as well."""
    from pressloom.queries import QUERIES

    rows = [(1, [1.0, 0.0], 1), (3, [0.8, 0.6], 1), (5, [0.0, 1.0], 2), (2, [-1.0, 0.0], 3), (7, [0.5, 0.5], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    docs = [(1, "a b", "en", "src0"), (3, "c d", "en", "src2"), (2, "e", "en", "src2")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["topic_key"]: r["sim"] for r in QUERIES["ml04"](spark, str(tmp_path)).collect()}
    assert got == {1: 0.948683, 2: 1.0, 3: 1.0}
