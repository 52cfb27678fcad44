"""Volumes that are clustered, documents drawn to judge topics, settings judged at once, languages."""

from collections import Counter
from datetime import date

from pyspark.sql import functions as F

from pressloom.operators import density, language, topics


def test_volumes_take_the_day_the_week_or_nothing(spark):
    rows = [("tv", date(2024, 1, 1), p) for p in "abc"] + [("tv", date(2024, 1, 6), p) for p in "ab"] + [("tv", date(2024, 1, 9), "a"), ("vk", date(2024, 1, 6), "a"), ("vk", None, "b"), (None, date(2024, 1, 6), "b")]
    df = spark.createDataFrame(rows, "portee string, day date, parent string")
    decided = topics.volumes(df, docs=3, parents=3)
    got = {(r.portee, str(r.day)): (r.docs, r.parents, r.wide_docs, r.wide_parents, r.takes) for r in decided.collect()}
    assert got == {("tv", "2024-01-01"): (3, 3, 3, 3, "day"), ("tv", "2024-01-06"): (2, 2, 5, 3, "week"), ("tv", "2024-01-09"): (1, 1, 3, 2, "noise"), ("vk", "2024-01-06"): (1, 1, 1, 1, "noise")}
    taken = topics.taken(df, decided).collect()
    assert Counter((r.portee, str(r.of), r.own) for r in taken) == {("tv", "2024-01-01", True): 3, ("tv", "2024-01-06", True): 2, ("tv", "2024-01-06", False): 3}
    assert topics.volumes(df.limit(0)).collect() == []


def test_draws_are_the_same_however_rows_lie(spark):
    rows = [(k, f"doc{k}-{i}", (i * 7 % 10) / 10) for k, n in ((-1, 30), (1, 400), (2, 12), (3, 11), (4, 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "topic_key int, article_id string, probability double")
    draws = [{tuple(r) for r in topics.drawn(x).collect()} for x in (df.coalesce(1), df.repartition(7, "probability"), df.repartition(3, "article_id"))]
    assert draws[0] == draws[1] == draws[2]
    by = Counter((r[0], r[1]) for r in draws[0])
    assert by == {(k, role): n for k in (1, 2, 3) for role, n in (("member", 5), ("test", 6), ("stranger", 6))}
    topic = {a: k for k, a, _ in rows}
    assert all((topic[a] == k) == (role != "stranger") and topic[a] > 0 for k, role, _, a in draws[0])
    assert len({r[3] for r in draws[0] if r[0] == 1}) == 17
    best = sorted(((-p, a) for k, a, p in rows if k == 2))
    assert {(r[3]) for r in draws[0] if r[0] == 2 and r[1] == "member"} == {a for _, a in best[:5]}
    assert topics.drawn(df.filter("topic_key = 3")).filter("role = 'stranger'").collect() == []


def test_a_grid_equals_separate_runs(spark):
    docs = spark.createDataFrame([("a", i, [float(i % 4) + (i * 37 % 11) / 20, (i * 53 % 17) / 20]) for i in range(60)], "scope string, id long, vec array<double>")
    rows = spark.createDataFrame([(i, "tv" if i % 3 else "vk", f"p{i // 5}") for i in range(60)], "id long, kind string, parent string")
    settings = [("a", f"{m}-{k}", k, m) for k in (4, 8) for m in ("leaf", "eom")]
    schema = "scope string, setting string, least int, method string"
    whole = density.density_clusters(docs, spark.createDataFrame(settings, schema), samples=4)
    judged = {r.setting: r for r in density.grid(whole, rows).collect()}
    for s in settings:
        alone = density.density_clusters(docs, spark.createDataFrame([s], schema), samples=4)
        one = density.grid(alone, rows).collect()
        assert one == [judged[s[1]]] if s[1] in judged else one == []
        topic = {r.id: r.topic for r in alone.collect()}
        sizes = Counter(t for t in topic.values() if t >= 0)
        if sizes:
            kinds = Counter((t, "tv" if i % 3 else "vk") for i, t in topic.items() if t >= 0)
            pure = sum(max(n for (x, _), n in kinds.items() if x == t) for t in sizes)
            assert (one[0].themes, one[0].dominant, one[0].purete_media) == (len(sizes), round(100 * max(sizes.values()) / 60, 6), round(100 * pure / sum(sizes.values()), 6))
    assert judged


def test_languages(spark):
    learn = spark.createDataFrame([("the cat and the hat", "en"), ("le chat et le chapeau", "fr"), ("ohne Sprache", None), (None, "en")], "text string, lang string")
    texts = spark.createDataFrame([(1, "THE hat!"), (2, "les chapeaux"), (3, ""), (4, None), (5, "123 ..."), (6, "a"), (7, "日本 chat " * 3), (8, "the " * 50_000)], "key long, text string")
    known = language.profiles(learn)
    assert {r.key: r.language for r in language.identified(texts, known, "key").collect() if r.key != 6} == {1: "en", 2: "fr", 7: "fr", 8: "en"}
    assert language.identified(texts.limit(0), known, "key").collect() == []


def test_languages_without_moving_words(spark, monkeypatch):
    """Texts stay where they are, in chunks of some characters; profiles too large to be broadcast are joined, with the same result."""
    monkeypatch.setattr(language, "CHUNK", 40)
    rows = [(i, x, x.split()[0][:2]) for i, x in enumerate(["the cat's  hat", "le chat d'été", "der Hut, die Hüte", "e 日本 😀x 𝒜b the", "the", "LE", "thé dé", "der der der"] * 9)]
    texts = spark.createDataFrame([*rows, (None, "the", "th"), (90, "", "th"), (91, None, "le"), (92, "12", None)], "key long, text string, lang string")
    known = language.profiles(texts.filter("key % 3 > 0"))
    assert "MapInPandas" not in known._jdf.queryExecution().executedPlan().toString()  # texts aren't read for each sum
    words = [w for _, x, la in rows if la == "th" for w in ("".join(c if c.isalpha() else " " for c in x.lower())).split()]
    grams = Counter(f" {w} "[i : i + 3] for k, w in enumerate(words) for i in range(len(w)))
    counted = {r.gram: r.n for r in language._by_language(texts, "lang", "text", 3).filter("lang = 'th'").collect()}
    assert counted == {**grams, **{g: n + (g in (" th", "the", "he ")) for g, n in grams.items()}}  # the row without a key counts as well
    found = language.identified(texts, known, "key")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    monkeypatch.setattr(language, "FEW", 3)
    joined = language.identified(texts, known, "key")
    assert "Generate" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(found.collect()) == sorted(joined.collect()) and found.count() == len(rows)


def test_grams(spark):
    row = spark.createDataFrame([("abc", "é", "😀b")], "a string, b string, c string").select(*[language.grams(F.col(c)).alias(c) for c in "abc"]).first()
    assert row.a == [" ab", "abc", "bc "] and row.b == [" é "] and row.c == [" 😀b", "😀b "]
