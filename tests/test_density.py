import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.operators import density


def reach(vecs, k):
    d = np.sqrt(((vecs[:, None] - vecs[None]) ** 2).sum(-1))
    core = np.array([np.sort(np.delete(row, i))[min(k, len(row) - 1) - 1] for i, row in enumerate(d)])
    return np.maximum(d, np.maximum(core[:, None], core[None]))


def prim(m, names=None):
    """Edges (weight, x, y) of the minimum spanning tree, one document after another; ties: the smaller pair of names."""
    names = names or [*range(len(m))]
    key = lambda x, y: (m[x, y], min(names[x], names[y]), max(names[x], names[y]))
    inside, out = {0}, []
    while len(inside) < len(m):
        x, y = min(((x, y) for x in inside for y in range(len(m)) if y not in inside), key=lambda e: key(*e))
        inside.add(y)
        out.append((key(x, y), (m[x, y], x, y)))
    return [e for _, e in sorted(out)]


def parts(points, edges):
    """The two sides that are left of a tree when its heaviest edge goes."""
    rest = edges[:-1]
    side, grown = {edges[-1][1]}, True
    while grown:
        grown = False
        for _, x, y in rest:
            if (x in side) != (y in side):
                side |= {x, y}
                grown = True
    of = lambda s: (s, [e for e in rest if e[1] in s])
    return of(side), of(points - side)


def brute(points, edges, least, method):
    """Selected clusters below a cluster, as (mass, sets of points): the tree is cut from its heaviest edge on."""

    def walk(points, edges, birth):
        mass, inside = 0.0, set(points)
        while edges:
            at = 1 / edges[-1][0]
            (p, e), (q, f) = parts(points, edges)
            if len(p) >= least and len(q) >= least:
                mass += len(points) * (at - birth)
                below = [walk(p, e, at), walk(q, f, at)]
                under, sets = sum(b[0] for b in below), [s for b in below for s in b[1]]
                return (mass, [inside]) if method == "eom" and mass >= under else (under, sets)
            kept = next(((s, g) for s, g in ((p, e), (q, f)) if len(s) >= least), (set(), []))
            mass += (len(points) - len(kept[0])) * (at - birth)
            points, edges = kept
        return mass + (np.inf if points else 0), [inside]

    while edges:  # the whole is no cluster
        (p, e), (q, f) = parts(points, edges)
        if len(p) >= least and len(q) >= least:
            return [s for b in (walk(p, e, 1 / edges[-1][0]), walk(q, f, 1 / edges[-1][0])) for s in b[1]]
        points, edges = next(((s, g) for s, g in ((p, e), (q, f)) if len(s) >= least), (set(), []))
    return []


def blobs(seed, n):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(c, s, (n, 3)) for c, s in ((0, 0.3), (2, 0.5), (5, 0.2))] + [r.uniform(-3, 8, (n // 2, 3))])


@pytest.mark.parametrize("method", ["leaf", "eom"])
@pytest.mark.parametrize("seed", range(6))
def test_selection_equals_brute_force(seed, method):
    vecs = blobs(seed, 14)
    for least in (3, 5, 8):
        edges = prim(reach(vecs, least))
        w, a, b = (np.array(x) for x in zip(*edges, strict=True))
        labels = density.selected(a, b, w, least, method)
        got = {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels.tolist()) - {density.NOISE}}
        assert got == set(map(frozenset, brute(set(range(len(vecs))), edges, least, method)))


def test_tree_and_clusters_in_spark(spark, monkeypatch):
    """Blocks of a few documents, two scopes, string ids in another order than the vectors."""
    monkeypatch.setattr(density, "BLOCK", 9)
    scopes = {"global": blobs(1, 12), "tv": blobs(2, 6)}
    names = {s: random.Random(1).sample([f"d{i:03}" for i in range(len(v))], len(v)) for s, v in scopes.items()}
    rows = [(s, names[s][i], x.tolist()) for s, v in scopes.items() for i, x in enumerate(v)]
    docs = spark.createDataFrame([*rows, rows[0], ("tv", None, [0.0] * 3), ("tv", "none", None), ("one", "alone", [1.0] * 3)], "scope string, id string, vec array<double>")
    settings = spark.createDataFrame([(s, f"{m}-{k}", k, m) for s in ("global", "tv", "one") for k in (3, 5) for m in ("leaf", "eom")], "scope string, setting string, least int, method string")
    tree = density.density_tree(docs, settings.groupBy("scope").agg(F.min("least").alias("samples")))
    got = {}
    for r in tree.collect():
        got.setdefault(r.scope, []).append(r)
    assert set(got) == {"global", "tv"}
    topics = {(r.scope, r.setting, r.id): r.topic for r in density.density_clusters(docs, settings).collect()}
    assert topics["one", "leaf-3", "alone"] == topics["tv", "eom-5", "none"] == density.NOISE
    for s, vecs in scopes.items():
        edges = prim(reach(vecs, 3), names[s])
        assert [round(r.weight, 9) for r in sorted(got[s], key=lambda r: r.weight)] == [round(w, 9) for w, _, _ in edges]
        for k in (3, 5):
            for m in ("leaf", "eom"):
                want = {frozenset(names[s][i] for i in c) for c in brute(set(range(len(vecs))), edges, k, m)}
                found = {}
                for name in names[s]:
                    found.setdefault(topics[s, f"{m}-{k}", name], set()).add(name)
                found.pop(density.NOISE, None)
                assert set(map(frozenset, found.values())) == want


def test_tree_of_one_round(spark, monkeypatch):
    """Links in the order of weight, a, b, with copies and grid points (many ties), small tiles and several rounds of thinning; every pair of documents meets once in a pass, however many links are to be found. Vectors with a component that is no number take no part."""
    monkeypatch.setattr(density, "BLOCK", 7)
    r = np.random.default_rng(3)
    vecs = np.concatenate([r.integers(0, 3, (50, 2)).astype(float), np.full((12, 2), 0.5), r.normal(0, 1, (40, 2)) + 1e3])
    names = r.permutation(len(vecs)).tolist()
    rows = [("a", n, v.tolist()) for n, v in zip(names, vecs, strict=True)]
    docs = spark.createDataFrame([*rows, ("a", 500, [float("nan"), 0.0]), ("a", 501, [None, 0.0]), ("a", 502, [float("inf"), 0.0])], "scope string, id long, vec array<double>")
    near = spark.createDataFrame([("a", 4)], "scope string, samples int")
    met = spark.sparkContext.accumulator(0)
    real = density.tile_tree

    def counted(x, core, rank, first):
        met.add(first * (first - 1) // 2 if first == len(x) else first * (len(x) - first))
        return real(x, core, rank, first)

    monkeypatch.setattr(density, "tile_tree", counted)
    got = sorted((x.weight, x.a, x.b) for x in density.density_tree(docs, near).collect())
    assert got == [(w, min(names[x], names[y]), max(names[x], names[y])) for w, x, y in prim(reach(vecs, 4), names)]
    assert met.value <= len(vecs) * (len(vecs) - 1) // 2


@pytest.mark.parametrize("k", [1, 3])
def test_cores_of_large_tiles(spark, monkeypatch, k):
    """Groups of columns bound the k-th least; far from zero, products alone would be too coarse."""
    monkeypatch.setattr(density, "ROWS", 20)
    r = np.random.default_rng(k)
    vecs = np.concatenate([r.normal(0, 1e-3, (60, 4)) + 1e4, np.full((9, 4), 1e4), r.normal(0, 1, (61, 4))])
    docs = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(vecs)], "scope string, id long, vec array<double>")
    got = {x.id: x.core for x in density.core_distances(docs, spark.createDataFrame([("a", k)], "scope string, samples int")).collect()}
    d = np.sqrt(((vecs[:, None] - vecs[None]) ** 2).sum(-1))
    assert [got[i] for i in range(len(vecs))] == pytest.approx([np.sort(np.delete(row, i))[k - 1] for i, row in enumerate(d)], rel=1e-12, abs=0)


def test_equal_vectors_and_no_rows(spark):
    docs = spark.createDataFrame([("a", i, [float(i // 10), 0.0]) for i in range(30)], "scope string, id long, vec array<double>")
    settings = spark.createDataFrame([("a", "leaf", 4, "leaf")], "scope string, setting string, least int, method string")
    assert {(r.topic, r.n) for r in density.density_clusters(docs, settings).groupBy("topic").agg(F.count("*").alias("n")).collect()} == {(0, 10), (1, 10), (2, 10)}
    assert density.density_clusters(docs.limit(0), settings).collect() == []


@pytest.mark.parametrize(("name", "most"), [("ml02_tree", 30), ("ml09_grid", 50)])
def test_queries_take_few_jobs(spark, name, most):
    """The tree comes from a fixed number of passes, not from rounds that grow with the number of vectors."""
    from pressloom.queries import QUERIES

    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert len(tracker.getJobIdsForGroup(None)) - before <= most
