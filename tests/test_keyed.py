import pytest
from pyspark.sql import functions as F

from pressloom.sources.keyed import KeyedStore


def rows(spark, ids, urls=None):
    cells = [(None if i is None else f"i{i}", f"u{u}", n) for n, (i, u) in enumerate(zip(ids, urls or ids, strict=True))]
    return spark.createDataFrame(cells, "id string, url string, n int").withColumn("published_at", F.lit("2024-01-02").cast("timestamp"))


def stored(spark, path):
    return sorted((r["id"] or "", r["url"]) for r in spark.read.parquet(path).collect())


def test_appends_twice_and_across_sessions(spark, tmp_path):
    path = str(tmp_path / "a")
    KeyedStore(spark, path, buckets=4).append(rows(spark, [0, 1, 1, 2]))
    again = KeyedStore(spark, path, buckets=16)
    assert again.buckets == 4
    again.forget()  # as a session that doesn't know the index
    again.append(rows(spark, [1, 2, 3, 4], [1, 9, 3, 0]))  # 2 stored by id, 4 by url
    again.append(rows(spark, []))
    assert stored(spark, path) == [("i0", "u0"), ("i1", "u1"), ("i2", "u2"), ("i3", "u3")]
    assert spark.table(again._index()).count() == 8
    again.forget()


def test_null_keys_match_nothing(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "a"), buckets=2)
    for urls in ([1, 2, 3], [1, 2, 4]):
        store.append(rows(spark, [None, None, 7], urls))
    assert stored(spark, store.path) == [("", "u1"), ("", "u2"), ("i7", "u3")]
    store.forget()


@pytest.mark.parametrize("step", ["_write_rows", "_write_keys"])
def test_an_append_cut_off_and_repeated_adds_the_rest(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "a")
    store = KeyedStore(spark, path, buckets=2)
    store.append(rows(spark, [0, 1]))

    def lost(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, step, lost)
        with pytest.raises(OSError):
            store.append(rows(spark, [1, 2, 3]))
    assert KeyedStore(spark, path)._open().count() == 1
    for _ in range(2):
        KeyedStore(spark, path).append(rows(spark, [1, 2, 3, 4]))
    assert stored(spark, path) == [(f"i{i}", f"u{i}") for i in range(5)]
    assert KeyedStore(spark, path)._open().count() == 0
    store.forget()


def test_a_store_without_an_index_gets_one(spark, tmp_path):
    path = str(tmp_path / "a")
    rows(spark, [0, 1]).withColumn("published_date", F.to_date("published_at")).write.partitionBy("published_date").parquet(path)
    store = KeyedStore(spark, path, buckets=2)
    store.append(rows(spark, [1, 2]))
    assert stored(spark, path) == [("i0", "u0"), ("i1", "u1"), ("i2", "u2")]
    store.forget()


def test_stored_keys_are_not_shuffled(spark, tmp_path, capsys):
    """With sides too large to broadcast: nothing is exchanged between the index's scan and the join."""
    path = str(tmp_path / "a")
    store = KeyedStore(spark, path, buckets=4)
    store.append(rows(spark, range(50)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = rows(spark, range(40, 60))
        known = store.spark.table(store._index()).join(store.keys_of(batch).distinct(), ["kind", "key"])
        known.explain("formatted")
        plan = capsys.readouterr().out
        assert "Bucketed: true" in plan
        tree = plan.split("\n\n")[0].splitlines()
        at = next(i for i, x in enumerate(tree) if "Scan parquet" in x)
        depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
        line, above = depth(tree[at]), []
        for x in reversed(tree[:at]):
            if depth(x) < line:
                above.append(x)
                line = depth(x)
        below_join = above[: next(i for i, x in enumerate(above) if "Join" in x)]
        assert not any("Exchange" in x for x in below_join), plan
        assert known.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        store.forget()
