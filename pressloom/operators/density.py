"""Density clustering: spanning trees of mutual reachability by tiles, then condensed trees and the clusters selected in them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.sources.sinks import settled

NOISE = -1
#: Documents of one side of a tile at most, and at least where a scope has fewer than SIDES times that; tiles of one side whose forests meet in a task.
BLOCK, LEAST, SIDES, MERGED = 4096, 512, 24, 4
#: Documents of a tile that are measured against its other side at a time.
ROWS = 512


def _sizes(points: DataFrame) -> DataFrame:
    """scope, blocks: a row for each scope."""
    side = F.least(F.lit(BLOCK), F.greatest(F.lit(LEAST), F.ceil(F.count("*") / SIDES)))
    return points.groupBy("scope").agg(F.ceil(F.count("*") / side).cast("int").alias("blocks"))


def _tiles(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """scope, i, j, block and the points' columns: each point in every pair of blocks that its block is part of."""
    dealt = points.join(F.broadcast(sizes), "scope").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squares of all distances by products, and by how much they may differ from those of _distances."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = x @ (-2 * y.T)
    out += xx[:, None]
    out += yy[None, :]
    return out, 8 * (x.shape[1] + 8) * np.finfo(float).eps * (xx.max() + yy.max())


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the vectors in x to those beside them in y, added up one component after another: the same from either side, so that ties stay ties."""
    return np.sqrt(np.cumsum((x - y) ** 2, axis=1)[:, -1])


def _sides(tile: pd.DataFrame) -> list[pd.DataFrame]:
    """The two sides of a tile; a tile of one block has one."""
    return [tile[tile.block == k] for k in sorted({int(tile.i.iloc[0]), int(tile.j.iloc[0])})]


def core_distances(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """scope, id, vec, core: the distance of each document to its samples-th nearest other one of its scope (to the farthest, if it has fewer).

    docs: scope, id, vec; samples: scope, samples. All of a scope's documents are
    compared, block by block; each tile keeps its nearest few of each document.
    Products tell which may be among them; those are measured.
    """
    points = docs.join(F.broadcast(samples), "scope")

    def few(x: np.ndarray, y: np.ndarray, k: int, same: bool) -> list[list[float]]:
        out = []
        for at in range(0, len(x), ROWS):
            part = x[at : at + ROWS]
            d, tolerance = _squares(part, y)
            if same:
                d[np.arange(len(part)), np.arange(at, at + len(part))] = np.inf
            # the k-th least of the least of 8 k groups is no less than the k-th least of all
            groups = d[:, : len(y) // (8 * k) * 8 * k].reshape(len(d), -1, 8 * k).min(axis=1) if len(y) >= 16 * k else d
            last = np.partition(groups, min(k, groups.shape[1]) - 1, axis=1)[:, min(k, groups.shape[1]) - 1]
            r, c = np.nonzero((d <= last[:, None] + 2 * tolerance) & (d < np.inf))
            exact = np.concatenate([_distances(part[r[p : p + BLOCK]], y[c[p : p + BLOCK]]) for p in range(0, max(len(r), 1), BLOCK)])
            order = np.lexsort((exact, r))
            out += [x[:k].tolist() for x in np.split(exact[order], np.searchsorted(r, np.arange(1, len(part))))]
        return out

    def nearest(tile: pd.DataFrame) -> pd.DataFrame:
        k, sides = int(tile.samples.iloc[0]), _sides(tile)
        vecs = [np.stack(a.vec.to_numpy()) if len(a) else None for a in sides]
        pairs = [(0, 0)] if len(sides) == 1 else [(0, 1), (1, 0)] if all(map(len, sides)) else []
        out = [pd.DataFrame({"scope": sides[a].scope.to_numpy(), "id": sides[a].id.to_numpy(), "near": few(vecs[a], vecs[b], k, a == b), "samples": k}) for a, b in pairs]
        return pd.concat(out) if out else pd.DataFrame(columns=["scope", "id", "near", "samples"])

    schema = f"scope {docs.schema['scope'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, near array<double>, samples int"
    near = _tiles(points, _sizes(docs)).groupBy("scope", "i", "j").applyInPandas(nearest, schema)
    core = near.groupBy("scope", "id", "samples").agg(F.collect_list("near").alias("near")).withColumn("near", F.slice(F.sort_array(F.flatten("near")), F.lit(1), F.col("samples")))
    return docs.join(core.select("scope", "id", F.coalesce(F.try_element_at("near", F.lit(-1)), F.lit(0.0)).alias("core")), ["scope", "id"])


def tile_tree(x: np.ndarray, core: np.ndarray, rank: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places a, b and weights of the minimum spanning tree of the links between the first documents and the others; of all links, if first is their number. Ties: the smaller pair of ranks.

    Prim's algorithm. A square by products, less its error, bounds a link from
    below; only links that may be as light as a document's lightest are measured.
    """
    n = len(x)
    every = first == n
    bound, tolerance = _squares(x[:first], x if every else x[first:])
    bound -= tolerance
    np.fmax(bound, (core[:first] ** 2)[:, None], out=bound)  # where squares overflow, too
    np.maximum(bound, (core if every else core[first:])[None, :] ** 2, out=bound)
    least, most, partner = np.full(n, np.inf), np.full(n, np.inf), np.full(n, -1)  # most: the square up to which a link may be lighter; -inf inside
    a, b, weight = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64), np.empty(n - 1)

    def order(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        x, y = rank[p], rank[q]
        return np.minimum(x, y) * n + np.maximum(x, y)

    v = 0
    for k in range(n - 1):
        least[v], most[v] = np.inf, -np.inf
        if every:
            to = np.flatnonzero(bound[v] <= most)
        elif v < first:
            to = np.flatnonzero(bound[v] <= most[first:]) + first
        else:
            to = np.flatnonzero(bound[:, v - first] <= most[:first])
        if len(to):
            w = np.maximum(np.maximum(_distances(x[to], x[v]), core[to]), core[v])
            better = w < least[to]
            ties = np.flatnonzero(w == least[to])
            if len(ties):
                t = to[ties]
                better[ties] = (partner[t] < 0) | (order(t, np.full(len(t), v)) < order(t, partner[t]))
            to, w = to[better], w[better]
            least[to], most[to], partner[to] = w, w * w * (1 + 1e-14), v
        u = int(least.argmin())
        ties = np.flatnonzero(least == least[u])
        if len(ties) > 1:
            u = int(ties[order(ties, partner[ties]).argmin()])
        a[k], b[k], weight[k] = partner[u], u, least[u]
        v = u
    return a, b, weight


def lightest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which links make the minimum spanning forest of a graph, by weight, a and b: places, in that order."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    order = np.lexsort((y, x, weight))
    top, kept = [*range(len(ids))], []
    for k, p, q in zip(order.tolist(), x[order].tolist(), y[order].tolist(), strict=True):
        while top[p] != p:
            top[p] = p = top[top[p]]
        while top[q] != q:
            top[q] = q = top[top[q]]
        if p != q:
            top[p] = q
            kept.append(k)
    return np.array(kept, np.int64)


def spanning_tree(points: DataFrame) -> DataFrame:
    """scope, a, b, weight: the minimum spanning tree of each scope's mutual reachability distances (ties: smaller a, then b; a < b).

    A link that isn't in the tree of some of the links isn't in the whole one: so
    every tile of two blocks gives the tree of its links, n * n / 2 pairs in all,
    once. Trees of neighbouring tiles are put together and thinned again, a square
    of tiles in a task, until one is left; the last task gets some trees of a
    scope's size, 24 bytes a link. (weight, a, b) orders all links, so there is
    one tree.
    """
    id_type = points.schema["id"].dataType.simpleString()
    scope_type = points.schema["scope"].dataType.simpleString()
    schema = f"scope {scope_type}, i int, j int, a {id_type}, b {id_type}, weight double"

    def table(scope, i, j, a, b, weight) -> pd.DataFrame:
        turned = a > b
        return pd.DataFrame({"scope": scope, "i": i, "j": j, "a": np.where(turned, b, a), "b": np.where(turned, a, b), "weight": weight})

    def tree(tile: pd.DataFrame) -> pd.DataFrame:
        sides = _sides(tile)
        rows = pd.concat(sides)
        if not all(map(len, sides)) or len(rows) < 2:
            return pd.DataFrame(columns=["scope", "i", "j", "a", "b", "weight"])
        ids = rows.id.to_numpy()
        a, b, weight = tile_tree(np.stack(rows.vec.to_numpy()), rows.core.to_numpy(), np.unique(ids, return_inverse=True)[1], len(sides[0]))
        return table(tile.scope.iloc[0], tile.i.iloc[0], tile.j.iloc[0], ids[a], ids[b], weight)

    def thin(trees: pd.DataFrame) -> pd.DataFrame:
        return trees.iloc[lightest(trees.a.to_numpy(), trees.b.to_numpy(), trees.weight.to_numpy())]

    sizes = _sizes(points)
    blocks = sizes.agg(F.max("blocks")).first()[0] or 1
    made = _tiles(points, sizes).groupBy("scope", "i", "j").applyInPandas(tree, schema)
    while blocks > 1:
        blocks = -(-blocks // MERGED)
        made = made.withColumns({c: F.floor(F.col(c) / MERGED).cast("int") for c in "ij"}).groupBy("scope", "i", "j").applyInPandas(thin, schema)
    return made.select("scope", "a", "b", "weight")


def condensed(a: np.ndarray, b: np.ndarray, weight: np.ndarray, least: int) -> tuple[list[int], list[float], list[tuple[int, float, int]], list[tuple[int, int, float]]]:
    """A tree's condensed hierarchy: each cluster's parent and birth, the clusters that documents leave (cluster, lambda, document), and the sizes that splits carry away.

    Edges are (place, place, weight) in ascending order. Going down from the whole,
    a split into two parts of `least` documents at least makes two clusters; a
    smaller part leaves its cluster, at lambda = 1 / weight.
    """
    n = len(a) + 1
    top, size = [*range(n)], [1] * n
    children: list[tuple[int, int, float]] = []

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for x, y, w in zip(a.tolist(), b.tolist(), weight.tolist(), strict=True):
        x, y = root(x), root(y)
        top[x] = top[y] = len(top)
        top.append(len(top))
        size.append(size[x] + size[y])
        children.append((x, y, w))
    parents, births, left, splits = [-1], [0.0], [], []

    def members(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += children[x - n][:2]
        return out

    todo = [(len(top) - 1, 0)]
    while todo:
        node, cluster = todo.pop()
        if node < n:
            left.append((cluster, np.inf, node))
            continue
        x, y, w = children[node - n]
        at = 1 / w if w > 0 else np.inf
        big = [c for c in (x, y) if size[c] >= least]
        for c in (x, y):
            if len(big) == 2:
                parents.append(cluster)
                births.append(at)
                splits.append((cluster, size[c], at))
                todo.append((c, len(parents) - 1))
            elif c in big:
                todo.append((c, cluster))
            else:
                left += [(cluster, at, m) for m in members(c)]
    return parents, births, left, splits


def selected(a: np.ndarray, b: np.ndarray, weight: np.ndarray, least: int, method: str) -> np.ndarray:
    """Labels from 0 of a tree's documents, NOISE outside the selected clusters; the whole is never one.

    method leaf: the clusters without clusters below. method eom (excess of mass):
    those whose stability, the sum of lambda minus birth over documents, is at
    least that of the best below them.
    """
    n = len(a) + 1
    parents, births, left, splits = condensed(a, b, weight, least)
    mass = np.zeros(len(parents))
    with np.errstate(invalid="ignore"):
        for c, at, _ in left:
            mass[c] += 0.0 if at == births[c] else at - births[c]
        for c, k, at in splits:
            mass[c] += 0.0 if at == births[c] else k * (at - births[c])
    below: list[list[int]] = [[] for _ in parents]
    for c, p in enumerate(parents):
        if p >= 0:
            below[p].append(c)
    best, keep = mass.copy(), [not below[c] for c in range(len(parents))]
    for c in range(len(parents) - 1, 0, -1):
        if below[c]:
            under = sum(best[d] for d in below[c])
            keep[c] = method == "eom" and mass[c] >= under
            best[c] = mass[c] if keep[c] else under
    owner = [NOISE] * len(parents)
    for c in range(1, len(parents)):  # a cluster is made after its parent
        owner[c] = owner[parents[c]] if owner[parents[c]] != NOISE else c if keep[c] else NOISE
    labels = np.full(n, NOISE)
    for c, _, m in left:
        labels[m] = owner[c]
    first = {c: k for k, c in enumerate(sorted({*labels.tolist()} - {NOISE}))}
    return np.array([first.get(c, NOISE) for c in labels.tolist()])


def clusters(docs: DataFrame, tree: DataFrame, settings: DataFrame) -> DataFrame:
    """scope, setting, id, topic (NOISE: none): the clusters of every setting (scope, setting, least, method) from one spanning tree.

    A scope's hierarchy is made in one task for each setting, from 24 bytes a
    document: merging in order of weight has to see the whole tree. Scopes and
    settings run side by side. Documents of a scope without links are noise.
    """
    id_type, scope_type = docs.schema["id"].dataType.simpleString(), docs.schema["scope"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "a", "b"])
        ids, at = np.unique(np.concatenate([pdf.a.to_numpy(), pdf.b.to_numpy()]), return_inverse=True)
        topic = selected(at[: len(pdf)], at[len(pdf) :], pdf.weight.to_numpy(), int(pdf.least.iloc[0]), pdf.method.iloc[0])
        return pd.DataFrame({"scope": pdf.scope.iloc[0], "setting": pdf.setting.iloc[0], "id": ids, "topic": topic})

    made = tree.join(F.broadcast(settings), "scope").groupBy("scope", "setting").applyInPandas(run, f"scope {scope_type}, setting string, id {id_type}, topic int")
    every = docs.select("scope", "id").join(F.broadcast(settings.select("scope", "setting")), "scope")
    return every.join(made, ["scope", "setting", "id"], "left").select("scope", "setting", "id", F.coalesce("topic", F.lit(NOISE)).alias("topic"))


def density_tree(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """The spanning trees of docs (scope, id, vec). Rows with a null scope, id or vector, or one with a component that is no number, take no part; of rows that repeat an id one does."""
    rows = docs.select("scope", "id", F.transform("vec", lambda v: v.cast("double")).alias("vec")).dropna().dropDuplicates(["scope", "id"])
    rows = rows.filter(F.forall("vec", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))))
    return spanning_tree(settled(core_distances(rows, samples), "cores"))


def density_clusters(docs: DataFrame, settings: DataFrame, samples: int | None = None) -> DataFrame:
    """scope, setting, id, topic by density; samples: how many neighbours a document's density takes (the smallest `least` of the scope, if not given)."""
    near = settings.groupBy("scope").agg((F.min("least") if samples is None else F.lit(samples)).cast("int").alias("samples"))
    return clusters(docs.dropDuplicates(["scope", "id"]), settled(density_tree(docs, near), "tree"), settings)


def grid(assigned: DataFrame, rows: DataFrame) -> DataFrame:
    """setting, themes, dominant, non_classe, purete_media, mono_parent, score of every setting, judged at once (parts in per cent of rows: id, kind, parent).

    dominant: the largest topic's part of all documents; purete_media and
    mono_parent: the parts of classified documents that are of their topic's
    commonest kind and parent. score: dominant + purete_media + mono_parent, low is good.
    """
    x = assigned.select("setting", "id", "topic").join(rows.select("id", "kind", "parent"), "id")
    part = lambda c: x.filter("topic >= 0").groupBy("setting", "topic", c).agg(F.count("*").alias("n")).groupBy("setting", "topic").agg(F.max("n").alias(f"top_{c}"), F.sum("n").alias("size"))
    by = part("kind").join(part("parent").drop("size"), ["setting", "topic"]).groupBy("setting")
    t = by.agg(F.count("*").alias("themes"), F.max("size").alias("largest"), F.sum("size").alias("classed"), F.sum("top_kind").alias("pure"), F.sum("top_parent").alias("mono"))
    of = lambda a, b: F.round(100 * F.col(a) / F.col(b).cast("double"), 6)
    out = t.join(x.groupBy("setting").agg(F.count("*").alias("all_n")), "setting")
    out = out.select("setting", "themes", of("largest", "all_n").alias("dominant"), F.round(100 - 100 * F.col("classed") / F.col("all_n").cast("double"), 6).alias("non_classe"), of("pure", "classed").alias("purete_media"), of("mono", "classed").alias("mono_parent"))
    return out.withColumn("score", F.round(F.col("dominant") + F.col("purete_media") + F.col("mono_parent"), 6)).orderBy("score", "setting")

