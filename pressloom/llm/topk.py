"""Exact top-k inner products: dual-tree search over cover trees of query groups and data blocks."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.shared import settle

#: Rows in a block of data or a group of queries, about; bounds what a task holds.
BLOCK, GROUP = 4096, 1024
#: Vectors that the pivots of the cells are chosen from, and the most pivots, which the driver holds. There is one for each BLOCK rows below that.
SAMPLE, PIVOTS = 8192, 1024
#: Rows in a leaf of a block's tree and of a query group's, about; rows that are scored in one product.
_LEAF, _QUERIES, _CHUNK = 64, 256, 1024
#: Room for rounding in bounds, as a part of the norms; scores themselves are whole numbers.
_SLACK = 1e-9
#: Products below this are exact in doubles.
_EXACT = 2.0**53


@dataclass
class Tree:
    """Balls in the order of their levels. Ball i covers rows start[i] to end[i] of the tree's own order within radius[i] of row centre[i]; its children are first[i] to last[i]."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def leaf(self, i) -> np.ndarray:
        return self.first[i] == self.last[i]

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """Leaves stay, other nodes give way to their children."""
        inner = nodes[~self.leaf(nodes)]
        n = self.last[inner] - self.first[inner]
        ends = np.cumsum(n)
        return np.concatenate([nodes[self.leaf(nodes)], np.arange(n.sum()) + np.repeat(self.first[inner] - (ends - n), n)])


def cover_tree(vectors: np.ndarray, leaf: int = _LEAF) -> Tree:
    """A cover tree down to leaves of about `leaf` rows or of equal rows.

    A node's centres are its own centre and then, farthest first, rows of it,
    until they cover it within half its radius: they are then apart by more than
    the radius they cover with. Where rows are so far from each other that this
    takes more centres than the node would fill leaves, its level ends at that
    many centres, at the radius that they cover with.
    """
    order = np.arange(len(vectors))
    far = [np.linalg.norm(vectors - vectors[0], axis=1)]
    start, end, centre, radius, first, last = [0], [len(vectors)], [0], [], [], []
    at = 0
    while at < len(start):
        rows, near = order[start[at] : end[at]].copy(), far[at]
        far[at] = None
        radius.append(float(near.max(initial=0)))
        first.append(len(start))
        if len(rows) > leaf and radius[at] > 0:
            centres, owner = [centre[at]], np.zeros(len(rows), np.int64)
            while near.max() > radius[at] / 2 and len(centres) <= len(rows) // leaf:
                k = int(near.argmax())
                d = np.linalg.norm(vectors[rows] - vectors[rows[k]], axis=1)
                closer = d < near
                owner[closer], near[closer] = len(centres), d[closer]
                centres.append(int(rows[k]))
            by = np.argsort(owner, kind="stable")
            order[start[at] : end[at]] = rows[by]
            ends = start[at] + np.cumsum(np.bincount(owner, minlength=len(centres)))
            for c, (row, stop) in enumerate(zip(centres, ends.tolist(), strict=True)):
                start.append(start[at] if c == 0 else end[-1])
                end.append(stop)
                centre.append(row)
                far.append(near[owner == c])
        last.append(len(start))
        at += 1
    place = np.argsort(order)
    return Tree(order, *(np.array(x, np.int64) for x in (start, end)), place[centre], np.array(radius), *(np.array(x, np.int64) for x in (first, last)))


def _merge(scores, s_ids, best, ids, k):
    """The k best of both, ties to the smaller id."""
    s, n = np.concatenate([best, scores]), np.concatenate([ids, s_ids])
    at = np.lexsort((n, -s))[:k]
    return s[at], n[at]


def _exact(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As dual_search, in whole numbers of any size, row by row; scores beyond 64 bits are the nearest such number."""
    best, ids = np.zeros((len(q), k), np.int64), np.full((len(q), k), -1, np.int64)
    whole = lambda x: np.array([[int(c) for c in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    data = whole(p)
    for i, x in enumerate(whole(q)):
        scored = sorted((-max(-(2**63), min(2**63 - 1, s)), n) for s, n in zip(data @ x, p_ids.tolist(), strict=True) if n != q_ids[i])[:k]
        for j, (s, n) in enumerate(scored):
            best[i, j], ids[i, j] = -s, n
    return best, ids


def dual_search(q: np.ndarray, q_ids: np.ndarray, p: np.ndarray, p_ids: np.ndarray, qt: Tree, pt: Tree, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each query over the rows p, those below the query's floor aside; ids -1 where there are fewer. Both sides stand in their trees' order.

    Both trees are descended together: a node of queries takes along the nodes of
    data that it can't rule out, a level deeper each time. A pair of nodes is left
    out when the largest inner product that their centres and radii allow is below
    the worst kth score of the node's queries. A leaf of queries scores what leaves
    are left to it from the most promising on, in products of bounded size, until
    its worst kth score rules out the rest.
    """
    if np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * q.shape[1] >= _EXACT:
        return _exact(q, q_ids, p, p_ids, k)
    best, ids, kth = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64), floor.astype(float)
    qc, pc = q[qt.centre], p[pt.centre]
    qn, pn = np.linalg.norm(qc, axis=1), np.linalg.norm(pc, axis=1)

    def most(a: int, nodes: np.ndarray) -> np.ndarray:
        reach = qt.radius[a] * pn[nodes] + pt.radius[nodes] * qn[a] + qt.radius[a] * pt.radius[nodes]
        return pc[nodes] @ qc[a] + reach + _SLACK * (qn[a] * pn[nodes] + reach)

    def scored(a: int, leaves: np.ndarray) -> None:
        rows = np.concatenate([np.arange(pt.start[i], pt.end[i]) for i in leaves])
        mine = slice(qt.start[a], qt.end[a])
        scores = q[mine] @ p[rows].T
        hit = (scores >= kth[mine, None]) & (q_ids[mine, None] != p_ids[rows][None, :])
        for i in np.flatnonzero(hit.any(axis=1)):
            r, here = qt.start[a] + i, hit[i]
            best[r], ids[r] = _merge(scores[i][here], p_ids[rows[here]], best[r], ids[r], k)
            kth[r] = max(kth[r], best[r, -1])

    stack = [(0, np.zeros(min(1, len(p)), np.int64))] if len(q) else []
    while stack:
        a, nodes = stack.pop()
        bound = most(a, nodes)
        worst = kth[qt.start[a] : qt.end[a]].min()
        nodes, bound = nodes[bound >= worst], bound[bound >= worst]
        if not len(nodes):
            continue
        if not qt.leaf(a):
            stack += [(c, pt.below(nodes)) for c in range(qt.first[a], qt.last[a])]
        elif not pt.leaf(nodes).all():
            stack.append((a, pt.below(nodes)))
        else:
            by = np.argsort(-bound, kind="stable")
            nodes, bound = nodes[by], bound[by]
            size = np.cumsum(pt.end[nodes] - pt.start[nodes])
            at = 0
            while at < len(nodes) and bound[at] >= kth[qt.start[a] : qt.end[a]].min():
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _CHUNK, "right")))
                scored(a, nodes[at:to])
                at = to
    return np.where(ids >= 0, best, 0).astype(np.int64), ids


def quantised(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, as doubles. Vectors null or holding null, NaN or infinite components take no part, nor do those that are infinite when scaled."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double") * scale)
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda c: F.when(F.abs(c) < _EXACT, F.floor(c).cast("double")).otherwise(c))
    return embeddings.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _pivots(vectors: DataFrame, width: int, many: int) -> np.ndarray:
    """Rows far from each other, chosen from the SAMPLE rows of least hash. They steer the search, not its result."""
    sample = vectors.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    x = _matrix([r["v"] for r in sample], width)
    chosen, near = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(many, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def top_k(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id, v) the k rows of data with the largest inner products, ties to the smaller vec_id.

    Pivots split both sides into cells, cells into blocks of bounded size by a
    hash, each with its cover tree. A query group first searches the nearest
    cell, block by block; its worst kth score then excludes the cells whose
    balls can't reach it, and the floors of its queries prune pairs of nodes in
    the blocks of the others. The partial answers (k a block at most) are
    ranked last.

    A row with the query's own id never answers it. Repeated data rows each
    count; a repeated query id is answered once, by its smallest vector. Vectors
    of unequal lengths are as if filled up with zeros. Scores are exact; one
    beyond 64 bits is the nearest such number, and ties with others like it. Empty
    sides: no rows.
    """
    spark = data.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    data = settle(data.select("vec_id", "v"), "vectors")
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    facts = data.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    width = max(1, facts["width"], queries.agg(F.max(F.size("v"))).first()[0] or 0)
    pivots = _pivots(data, width, min(PIVOTS, max(1, facts["n"] // BLOCK)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["v"], width)
            d = np.stack([np.linalg.norm(x - c, axis=1) for c in pivots], axis=1)
            yield pdf.assign(cell=d.argmin(axis=1).astype(np.int32), far=d.min(axis=1))

    def blocks(df: DataFrame, rows: int, leaf: int, name: str) -> DataFrame:
        """cell, block, radius, packed: ids, vectors and tree of each block."""
        dealt = settle(df.mapInPandas(assign, "vec_id long, v array<double>, cell int, far double"), name)
        cells = dealt.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("long").alias("parts"))  # a row for each pivot
        dealt = dealt.join(F.broadcast(cells), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")))

        def tree(pdf: pd.DataFrame) -> pd.DataFrame:
            x, far = _matrix(pdf["v"], width), float(pdf["far"].max())
            t = cover_tree(x, leaf)
            ids, x = pdf["vec_id"].to_numpy(np.int64)[t.order], x[t.order]
            small = next((k for k in (np.int16, np.int32) if np.abs(x).max(initial=0) <= np.iinfo(k).max), np.float64)
            return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "block": [pdf["block"].iloc[0]], "radius": [far], "packed": [pickle.dumps((ids, x.astype(small), t))]})

        return settle(dealt.groupBy("cell", "block").applyInPandas(tree, "cell int, block long, radius double, packed binary"), f"{name}-trees")

    groups, parts = blocks(queries, GROUP, _QUERIES, "queries"), blocks(data, BLOCK, _LEAF, "data")
    radii = np.full(len(pivots), -1.0)
    for r in parts.groupBy("cell").agg(F.max("radius").alias("r")).collect():  # a row for each pivot
        radii[r["cell"]] = r["r"]
    near = np.linalg.norm(pivots[:, None] - pivots[None], axis=2)
    near[:, radii < 0] = np.inf
    home = near.argmin(axis=1)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                q_ids, q, qt = pickle.loads(row.group)
                p_ids, p, pt = pickle.loads(row.packed)
                floor = np.frombuffer(row.floors) if row.floors is not None else np.full(len(q), -np.inf)
                best, ids = dual_search(q.astype(float), q_ids, p.astype(float), p_ids, qt, pt, k, floor)
                at, rank = np.nonzero(ids >= 0)
                yield pd.DataFrame({"gcell": row.gcell, "gblock": row.gblock, "query_id": q_ids[at], "vec_id": ids[at, rank], "score": best[at, rank]})

    # a pair of blocks is seconds of work in a few bytes: it is dealt by itself, not by what its bytes would fill
    tasks = min(2000, max(1, groups.count() * parts.count()))

    def searched(pairs: DataFrame) -> DataFrame:
        dealt = pairs.repartition(tasks, "gcell", "gblock", "cell", "block")
        return dealt.select("gcell", "gblock", "group", "floors", "packed").mapInPandas(search, found)

    found = "gcell int, gblock long, query_id long, vec_id long, score long"
    named = groups.select(F.col("cell").alias("gcell"), F.col("block").alias("gblock"), F.col("packed").alias("group"))
    homes = F.element_at(F.array(*[F.lit(int(h)) for h in home]), F.col("gcell") + 1)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = named.withColumn("cell", homes).withColumn("floors", F.lit(None).cast("binary")).join(parts, "cell")
    first = settle(searched(first).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k), "near")
    kth = first.groupBy("gcell", "gblock", "query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst")).filter(F.col("n") == k)
    kth = kth.groupBy("gcell", "gblock").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "worst"))).alias("worst"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells that a group must still visit, with the floors of its queries."""
        for pdf in batches:
            for row in pdf.itertuples():
                q_ids, q, _ = pickle.loads(row.group)
                q = q.astype(float)
                worst = dict(row.worst) if row.worst is not None else {}
                floors = np.array([float(worst.get(i, -np.inf)) for i in q_ids.tolist()])
                size = np.linalg.norm(q, axis=1)[:, None]
                most = q @ pivots.T + size * np.maximum(radii, 0)[None] + _SLACK * size * (np.linalg.norm(pivots, axis=1) + np.maximum(radii, 0))[None]
                for cell in np.flatnonzero((most >= floors[:, None]).any(axis=0) & (radii >= 0)):
                    if cell != home[row.gcell]:
                        yield pd.DataFrame({"gcell": [row.gcell], "gblock": [row.gblock], "cell": [int(cell)], "floors": [floors.tobytes()]})

    to = named.join(kth, ["gcell", "gblock"], "left").mapInPandas(route, "gcell int, gblock long, cell int, floors binary")
    rest = searched(named.join(to, ["gcell", "gblock"]).join(parts, "cell"))
    every = first.select("query_id", "vec_id", "score").unionByName(rest.select("query_id", "vec_id", "score"))
    ranked = every.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
