import numpy as np

from pressloom.llm import topk


def brute(q, d, k):
    out = []
    for qi, qv in sorted({i: min(tuple(v) for j, v in q if j == i) for i, _ in q}.items()):
        dot = lambda v: sum(a * b for a, b in zip(qv, v, strict=False))
        best = sorted((-int(dot(v)), i) for i, v in d if i != qi)[:k]
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "GROUP", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 12)) * 30
    x = np.floor(np.concatenate([centres[rng.integers(8, size=500)] + rng.normal(size=(500, 12)) * 4, np.tile(centres[0], (150, 1))]))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(3, [float(a) for a in x[3]])]
    data = spark.createDataFrame(rows, "vec_id long, v array<double>")
    queries = data.filter("vec_id % 9 = 0")
    got = sorted(tuple(map(int, r)) for r in topk.top_k(queries, data, 5).collect())
    assert got == brute([r for r in rows if r[0] % 9 == 0], rows, 5)


def test_unusable_vectors_and_small_sides(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, []), (6, [0.5]), (7, [-0.001, 3.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 256)
    assert {r["vec_id"]: r["v"] for r in v.collect()} == {0: [256.0, 512.0], 5: [], 6: [128.0], 7: [-1.0, 768.0]}
    got = [tuple(r) for r in topk.top_k(v.filter("vec_id = 0"), v, 5).orderBy("rank").collect()]
    assert got == [(0, 1, 7, 392960), (0, 2, 6, 32768), (0, 3, 5, 0)]
    assert topk.top_k(v.limit(0), v, 5).count() == 0
    assert topk.top_k(v, v.limit(0), 5).count() == 0


def test_cover_tree_covers_and_separates():
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(3000, 5)), np.concatenate([rng.normal(size=(300, 3)) + c for c in rng.normal(size=(9, 3)) * 500])):
        t = topk.cover_tree(x, 16)
        y = x[t.order]
        assert sorted(t.order.tolist()) == list(range(len(x))) and (t.start[0], t.end[0]) == (0, len(x))
        for i in range(len(t.start)):
            rows, children = y[t.start[i] : t.end[i]], range(t.first[i], t.last[i])
            assert (np.linalg.norm(rows - y[t.centre[i]], axis=1) <= t.radius[i] + 1e-9).all()
            if children:
                assert t.start[children[0]] == t.start[i] and t.end[children[-1]] == t.end[i]
                assert all(t.end[a] == t.start[b] for a, b in zip(children, children[1:]))
                reach = max(t.radius[c] for c in children)
                apart = min(np.linalg.norm(y[t.centre[a]] - y[t.centre[b]]) for a in children for b in children if a < b)
                assert reach <= t.radius[i] and apart >= reach - 1e-9 and (reach <= t.radius[i] / 2 or len(children) >= len(rows) // 16)
            else:
                assert len(rows) <= 16 or t.radius[i] == 0
    assert len(topk.cover_tree(np.ones((500, 3))).start) == 1


def test_dual_search_over_deep_trees():
    rng = np.random.default_rng(5)
    p = np.floor(np.concatenate([rng.normal(size=(400, 6)) * 9 + c for c in rng.normal(size=(5, 6)) * 60] + [np.zeros((90, 6))]))
    q, ids = p[::17], np.arange(len(p))
    qt, pt = topk.cover_tree(q, 8), topk.cover_tree(p, 8)
    best, got = topk.dual_search(q[qt.order], ids[::17][qt.order], p[pt.order], ids[pt.order], qt, pt, 5, np.full(len(q), -np.inf))
    for i, row in enumerate(q[qt.order] @ p.T):
        row[ids[::17][qt.order[i]]] = -np.inf
        want = np.lexsort((ids, -row))[:5]
        assert got[i].tolist() == want.tolist() and best[i].tolist() == row[want].tolist()


def test_huge_components_are_scored_exactly(spark):
    rows = [(1, [2.0**40, 3.0]), (2, [2.0**40, 5.0]), (3, [2.0**40, 4.0]), (4, [1e12, -1e12]), (5, [-1e300, 1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 256)
    got = sorted(tuple(map(int, r)) for r in topk.top_k(v, v, 4).collect())
    whole = {i: [int(c * 256) for c in x] for i, x in rows}
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for i, x in whole.items():
        order = sorted((-clamp(sum(a * b for a, b in zip(x, y))), j) for j, y in whole.items() if j != i)[:4]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(order)]
    assert got == sorted(want)
    near = spark.createDataFrame([(1, [2.0**30, 1.0]), (2, [2.0**30, 3.0]), (3, [2.0**30, 2.0])], "vec_id long, v array<double>")
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(near.filter("vec_id = 1"), near, 2).orderBy("rank").collect()] == [(2, 2**60 + 3), (3, 2**60 + 2)]
