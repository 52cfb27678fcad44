import random
from itertools import combinations

import numpy as np
import pytest

from pressloom.llm import neardup
from pressloom.llm.textkit import shingles
from tests.llm.helpers import awkward, empty


def brute(rows, n, percent):
    ids = sorted({d for d, _ in rows})
    sets = {d: set(shingles(t or "", n).tolist()) for d, t in rows}
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(ids, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def family(rng, size, base_words, edits):
    base = [f"w{rng.randrange(4000)}" for _ in range(base_words)]
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
        yield " ".join(w)


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, words, percent):
    rng = random.Random(5)
    texts = [t for k in range(6) for t in family(rng, 40, 60 + 20 * k, 9)] + [" ".join(f"w{rng.randrange(4000)}" for _ in range(50)) for _ in range(40)] + ["a", "A", "a b", "", "  "] * 2
    rng.shuffle(texts)
    rows = list(enumerate(texts, 10))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == brute(rows, words, percent)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for overlap in (0, 100, 300, 400):
        a = rng.integers(0, 2**63, 400).astype(np.uint64)
        b = np.concatenate([a[:overlap], rng.integers(0, 2**63, 400 - overlap).astype(np.uint64)])
        sig = neardup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 400), 2, 140)
        errors.append(abs((sig[0] == sig[1]).mean() - overlap / (800 - overlap)))
    assert max(errors) < 0.12 and not (sig == neardup._NONE).any()


def test_one_element_fills_every_slot():
    sig = neardup.superminhash(np.array([7], np.uint64), np.array([0]), 1, 140)
    assert sorted((sig[0] >> np.uint64(48)).tolist()) == list(range(140))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_awkward_and_empty(spark):
    rows = {(r["doc_id"], r["n_shingles"]): r for r in neardup.near_duplicates(awkward(spark), 3, 85).collect()}
    assert rows[2, 0]["component_id"] == 2 and rows[3, 0]["kept"] and rows[4, 0]["component_id"] == 4
    assert rows[5, 1]["component_id"] == 5
    assert [r["component_id"] for (d, _), r in rows.items() if d is None] == [None]
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_drop_keeps_columns_and_one_row(spark):
    df = awkward(spark, [(9, "alpha beta gamma delta epsilon zeta eta theta", "en", "q", 1, 1.0, "x")])
    kept = neardup.drop_near_duplicates(df, 3, 85)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x) == [1, 2, 3, 4, 5, 6] and None in ids


def test_a_large_group_of_copies_that_differ_from_each_other(spark):
    """Several hundred near copies in families of their own, most of which aren't linked to each other."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    turned = list(base)
    turned[10:22] = [f"v{k}" for k in range(12)]
    texts = []
    for k in range(420):
        w = list(base if k % 3 else turned)
        for _ in range(rng.choice((1, 2, 3, 6, 12))):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(([], [f"e{rng.randrange(10**9)}"], [w[at], w[at]]))
        texts.append(" ".join(w))
    rows = [(7 * i % 421, t) for i, t in enumerate(texts)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == brute(rows, 3, 85)


def test_texts_of_one_id_are_one_document(spark):
    rows = [(5, "a b c d e f"), (5, "p q r s t u"), (9, "a b c d e f"), (3, "p q r s t u"), (8, "x y z"), (8, "x y z")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(5, 3), (9, 3), (3, 3), (8, 8)}


@pytest.mark.parametrize("few", [0, 250_000])
@pytest.mark.parametrize("known", [False, True])
def test_components_by_one_task_and_by_stars(spark, few, known):
    rng = random.Random(3)
    pairs = [(rng.randrange(1000), rng.randrange(1000)) for _ in range(600)] + [(7, 7), (2**60, -(2**60)), (2**60, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    got = neardup.components(edges, n=len(pairs) if known else None, few=few)
    assert [tuple(r) for r in got.orderBy("node").collect()] == sorted((x, find(x)) for x in root if find(x) != x)


def test_components_of_no_links(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert neardup.components(none).count() == 0 and neardup.components(none, few=-1).count() == 0


@pytest.mark.parametrize("few", [0, 250_000])
def test_parts_joined_by_links_between_them(spark, few, monkeypatch):
    monkeypatch.setattr(neardup.components, "__defaults__", (None, None, few))
    scratch = neardup.Scratch(spark)
    parts = spark.createDataFrame([(4, 1), (5, 1), (6, 2), (9, 3)], "node long, component long")
    links = spark.createDataFrame([(1, 2), (2, 7), (3, 8), (10, 11)], "a long, b long")
    got = neardup._joined(parts, links, 4, scratch)
    assert sorted(map(tuple, got.collect())) == [(2, 1), (4, 1), (5, 1), (6, 1), (7, 1), (8, 3), (9, 3), (11, 10)]
    scratch.drop()


def test_jobs_of_a_run_do_not_grow_with_rounds_of_stars(spark):
    """Every job leaves its plan and stages with the driver for the rest of the session."""
    rng = random.Random(5)
    texts = [t for k in range(6) for t in family(rng, 40, 60 + 20 * k, 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    group = "near-duplicate jobs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        neardup.near_duplicates(docs).count()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 90, jobs
