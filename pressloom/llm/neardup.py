"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.shared import Scratch, fresh_name, settle, texts
from pressloom.llm.textkit import mix, shingles

#: Elements whose permutations are held at a time.
_CHUNK = 150_000
_NONE = np.uint64(2**64 - 1)
_SLOT, _RANK = mix(np.arange(1024, dtype=np.uint64)), mix(np.arange(4096, 5120, dtype=np.uint64))


def superminhash(elements: np.ndarray, owner: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs x m, uint64) of the sets whose elements stand beside their owner's number.

    Each element visits the m slots in an order of its own (a Fisher-Yates
    shuffle seeded by it) and offers its j-th slot a value with rank j above a
    random fraction. A slot keeps the least offer, so a rank that comes later
    can't displace an earlier one: level after level, a document stops as soon
    as all its slots are filled.
    """
    sig = np.full(n_docs * m, _NONE)
    e, d, slots = elements, owner.astype(np.int64), None
    for j in range(m):
        if not len(e):
            break
        pick = j + (mix(e ^ _SLOT[j]) % np.uint64(m - j)).astype(np.int64)
        if j == 0:
            slot = pick
        else:
            rows = np.arange(len(e))
            slot = slots[rows, pick].astype(np.int64)
            slots[rows, pick] = slots[:, j]
        offer = (np.uint64(j) << np.uint64(48)) | (mix(e ^ _RANK[j]) >> np.uint64(16))
        np.minimum.at(sig, d * m + slot, offer)
        open_docs = (sig.reshape(n_docs, m) == _NONE).any(axis=1)
        stay = open_docs[d]
        if j == 0:
            e, d, pick = e[stay], d[stay], pick[stay]
            slots = np.tile(np.arange(m, dtype=np.uint16), (len(e), 1))
            slots[np.arange(len(e)), pick] = 0
        elif not stay.all():
            e, d, slots = e[stay], d[stay], slots[stay]
    return sig.reshape(n_docs, m)


def bands_for(similarity: float, rows: int = 5, miss: float = 1e-7) -> int:
    """Bands of so many rows that a pair at the similarity shares none of with probability miss at most."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def _class(s: np.ndarray) -> int:
    """A set's name, as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _features(n: int, rows: int, bands: int):
    m = rows * bands

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, n) for t in pdf["text"]]
            keys: list = [[]] * len(sets)
            at = 0
            while at < len(sets):
                to, size = at, 0
                while to < len(sets) and (to == at or size + len(sets[to]) <= _CHUNK):
                    size += len(sets[to])
                    to += 1
                part = sets[at:to]
                sig = superminhash(np.concatenate(part), np.repeat(np.arange(len(part)), [len(s) for s in part]), len(part), m)
                band = sig.reshape(len(part), bands, rows)
                key = mix(np.arange(bands, dtype=np.uint64))[None, :].repeat(len(part), axis=0)
                for r in range(rows):
                    key = mix(key * np.uint64(31) + band[:, :, r])
                for i, s in enumerate(part):
                    if len(s):
                        keys[at + i] = key[i].view(np.int64)
                at = to
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": [len(s) for s in sets], "class": [_class(s) for s in sets], "bands": keys})

    return run


def _sets(n: int):
    """class, set: the rows of a doc_id stand together; of its texts the one that its class was named by counts, once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, done = None, set()
        for pdf in batches:
            out = []
            for d, text, named in zip(pdf["doc_id"], pdf["text"], pdf["class"], strict=True):
                if d != last:
                    last, done = d, set()
                s = shingles(text, n)
                if named not in done and _class(s) == named:
                    done.add(named)
                    out.append((named, s.view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "set"])

    return run


#: Nodes that a task of _forest holds at a time.
_PART = 500_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one partition's edges: each node that isn't the smallest of its tree, beside that smallest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > _PART:  # a bounded part of the forest at a time; later rounds join the trees
            yield pd.DataFrame([(x, r) for x in parent if (r := find(x)) != x], columns=["a", "b"])
            parent.clear()
    yield pd.DataFrame([(x, r) for x in parent if (r := find(x)) != x], columns=["a", "b"]).astype("int64")


def _sight() -> tuple[Column, Column]:
    """What tells whether links have changed; n is their number."""
    return F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")


#: Links whose components one task finds: too few nodes to fill a part of _forest.
_FEW = _PART // 2


def components(edges: DataFrame, scratch: Scratch | None = None, n: int | None = None, few: int = _FEW) -> DataFrame:
    """node, component: the smallest node that links a, b reach; nodes without links are left out. n: the number of links, if known.

    Local union-find shrinks each partition to a forest. A few links, or a
    forest of few, are finished by one task, without a shuffle. Otherwise large-star and
    small-star steps (each node's neighbours move to its smallest neighbour)
    alternate until the edges no longer change, which needs rounds in the
    logarithm of the longest path. Minima are aggregated before they are joined,
    so that a node with very many links makes no large group.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    forest = lambda df: df.mapInPandas(_forest, "a long, b long")
    if n is None or n > few:
        edges, now = scratch.measured(forest(edges).distinct(), "forest", *_sight())
        n = now["n"]
    if n <= few:
        return forest(edges.coalesce(1)).select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while now != before:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ends.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        before = now
        edges, now = scratch.measured(small, "stars", *_sight())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _joined(parts: DataFrame, links: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """node, component as parts has them, once n links between its parts are added: only those parts are told anew.

    A part's smallest node isn't among the nodes of parts, so what joins another part is either such a node or a new one.
    """
    moved = components(links, scratch, n)
    to = moved.select(F.col("node").alias("of"), F.col("component").alias("to"))
    again = parts.join(to, parts["component"] == to["of"], "left").select("node", F.coalesce("to", "component").alias("component"))
    return scratch.settle(again.unionByName(moved), "parts")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b, with their other columns, whose full sets reach the similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - both
    return pairs.join(left, "a").join(right, "b").filter(100 * both >= percent * union).select(pairs.columns)


#: Rounds of stars before the exact comparison across parts; they only save it work.
_ROUNDS = 3


def _centres(links: DataFrame, parts: DataFrame) -> DataFrame:
    """part, centre: of each component of two documents or more the one with the most links found so far."""
    degrees = links.select(F.explode(F.array("a", "b")).alias("a")).groupBy("a").agg(F.count("*").alias("n"))
    named = degrees.join(parts, degrees["a"] == parts["node"], "left").select(F.coalesce("component", "a").alias("part"), "a", "n")
    return named.groupBy("part").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("centre"))


def _mixed_keys(part_of: DataFrame) -> DataFrame:
    """key, main: of each band key whose members are in several parts the part with the most of them."""
    sizes = part_of.groupBy("key", "part").agg(F.count("*").alias("c"))
    return sizes.groupBy("key").agg(F.max_by("part", F.struct("c", -F.col("part"))).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("key", "main")


def _between(one: tuple[str, str], other: tuple[str, str]) -> list[Column]:
    """a < b of two members, p < q of their parts. Given: their columns and those of their parts."""
    (x, p), (y, q) = one, other
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.least(p, q).alias("p"), F.greatest(p, q).alias("q")]


def _stars(part_of: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs a < b and their parts p < q: each member outside its key's main part with that part's centre, and with the smallest other such member if their parts differ."""
    outside = part_of.join(_mixed_keys(part_of), "key").filter("part <> main")
    to_centre = outside.join(centres.withColumnRenamed("part", "main"), "main").select(*_between(("centre", "main"), ("rep", "part")))
    least = outside.groupBy("key").agg(F.min("rep").alias("lead"), F.min_by("part", "rep").alias("of"))
    to_lead = outside.join(least, "key").filter("part <> of").select(*_between(("lead", "of"), ("rep", "part")))
    return to_centre.unionByName(to_lead).distinct()


def _across(part_of: DataFrame, centres: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links a, b between members of one band key that are in different parts p, q. part_of: key, rep, part.

    Keys with the same main part make a group; its hub L is that part's centre.
    Of a set x write r for how much of L it lacks, a for how much it adds, and
    w = 100 r + percent a. Two sets share |L| - r(x) - r(y) elements and as many
    more, D, as their differences from L have in common. So they are linked if
    and only if
        (100 + percent) D >= w(x) + w(y) - (100 - percent) |L|.
    As D can't exceed what either differs by, D is at least
        (w(y) - (100 - percent) |L|) / 100 whatever the partner, and at least
        (2 w(x) - (100 - percent) |L|) / (100 + percent) if the partner weighs no less.
    Each member is entered under its rarest differences, as many as leave fewer
    than that out: few where it is the lighter of a pair, more where it is the
    heavier. Pairs that meet at one whose place leaves room for D are compared in
    full, and no other pair can be linked. Copies that each changed other words
    meet nowhere, however many they are; members of one part are never paired.
    """
    held = part_of.join(_mixed_keys(part_of), "key").select(F.col("main").alias("grp"), "rep", "part").distinct()
    held = held.join(centres.withColumnRenamed("part", "grp"), "grp", "left").select("grp", F.coalesce("centre", "grp").alias("hub"), (F.col("part") == F.col("grp")).alias("inner"), "rep", "part")
    x = sets.select(F.col("doc_id").alias("rep"), F.col("set").alias("sx"))
    centre = sets.select(F.col("doc_id").alias("hub"), F.col("set").alias("sl"))
    lack, add = F.array_except("sl", "sx"), F.array_except("sx", "sl")
    facts = held.join(x, "rep").join(centre, "hub").select("grp", "hub", "inner", "rep", "part", F.size(lack).alias("r"), F.size(add).alias("a"), F.concat(lack, add).alias("diff"), ((100 - percent) * F.size("sl")).alias("room"))
    facts = facts.withColumns({"w": 100 * F.col("r") + percent * F.col("a"), "d": F.size("diff")})
    heavy = F.greatest(F.lit(1), F.ceil((F.col("w") - F.col("room")) / 100)).cast("int")
    light = F.greatest(heavy, F.ceil((2 * F.col("w") - F.col("room")) / (100 + percent)).cast("int"))
    facts = scratch.settle(facts.withColumns({"heavy": F.col("d") - heavy + 1, "light": F.col("d") - light + 1}), "differences")
    near = facts.filter("NOT inner AND w <= room").select(*_between(("hub", "grp"), ("rep", "part")))

    indexed = facts.select("hub", "inner", "rep", "part", "w", "r", "a", "d", "room", "heavy", "light", F.explode("diff").alias("elem"))
    met = indexed.groupBy("hub", "elem").agg(F.count("*").alias("df"), F.min("part").alias("low"), F.max("part").alias("high")).filter("df > 1")
    indexed = indexed.join(met.select("hub", "elem", "df", (F.col("low") < F.col("high")).alias("several")), ["hub", "elem"])
    own = Window.partitionBy("hub", "rep")
    at = F.row_number().over(own.orderBy("df", "elem")) + F.col("d") - F.count("*").over(own)  # differences that no other member has come first
    indexed = scratch.settle(indexed.withColumn("at", at.cast("int")).filter("several AND at <= heavy").drop("df", "several", "heavy"), "indexed")
    side = lambda df, s, *more: df.select("hub", "elem", *more, *[F.col(c).alias(c + s) for c in ("rep", "part", "w", "r", "a", "d", "at")])
    meets = F.explode(F.when(F.col("inner"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))  # what members of the main part needn't meet is itself
    lighter, heavier = side(indexed.filter("at <= light"), "1", meets.alias("inner")), side(indexed, "2", "inner", "room")
    need = F.col("w1") + F.col("w2") - F.col("room")
    ordered = (F.col("w1") < F.col("w2")) | (F.col("w1") == F.col("w2")) & (F.col("rep1") < F.col("rep2"))
    shared = F.least("r1", "r2") + F.least("a1", "a2")
    left = 1 + F.least(F.col("d1") - F.col("at1"), F.col("d2") - F.col("at2"))
    pairs = lighter.join(heavier, ["hub", "elem", "inner"]).filter((F.col("part1") != F.col("part2")) & ordered & ((100 + percent) * F.least(shared, left) >= need))
    pairs = pairs.select(*_between(("rep1", "part1"), ("rep2", "part2"))).distinct()
    return _confirm(pairs, sets, percent).unionByName(near)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id), kept, for every row of docs.

    Two documents are linked when 100 * intersection >= percent * union of
    their sets of word shingles. Rows with equal sets become one class first,
    so copies never make pairs. Classes that share a band are compared with the
    smallest of that band (a star, not all pairs); what is then in one component
    needs no more comparing. Stars around each component's centre and around the
    rest of each band follow while they find links, a few rounds at most. Pairs
    of different components that still share a band are either confirmed on
    their full sets or ruled out by what they differ in from the centre of their
    band's largest component (see _across), which is exact. Bands are chosen so
    that a pair at the threshold shares none with probability 1e-7.

    Null or empty text: n_shingles 0, linked with nothing. Rows that repeat a
    doc_id are one document, linked by each of their texts. A null doc_id: component_id null, kept true. Other
    columns of docs are ignored.
    """
    plain = texts(docs)
    bands = bands_for(percent / 100)
    features = settle(plain.mapInPandas(_features(words, 5, bands), "doc_id long, n_shingles long, class long, bands array<long>"), "shingled")
    known = features.filter("doc_id IS NOT NULL AND n_shingles > 0")
    scratch = Scratch(docs.sparkSession)

    classes = settle(known.groupBy("class").agg(F.min("doc_id").alias("first")), "classes")
    members = known.groupBy("class").agg(F.any_value("bands").alias("bands")).select(F.col("class").alias("rep"), F.explode("bands").alias("key")).repartition("key")
    lead = members.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).filter("lead < last").select("key", "lead")
    members = scratch.settle(members.join(lead, "key"), "members")
    involved = scratch.settle(members.select(F.col("rep").alias("class")).distinct().join(classes, "class").select("class", F.col("first").alias("doc_id")), "involved")
    # merged at every size: a broadcast of ids would move texts only where there are many of them
    sets = scratch.settle(plain.hint("merge").join(involved, "doc_id").mapInPandas(_sets(words), "doc_id long, set array<long>"), "sets")

    first = members.filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    ids = known.select("doc_id", "class")
    least = ids.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a < z").select("doc_id", "a")
    same = ids.join(least, "doc_id").filter("class <> a").select("a", F.col("class").alias("b")).distinct()  # texts of one doc_id
    count = F.count("*").alias("n")
    links, size = scratch.measured(_confirm(first, sets, percent).unionByName(same), "links", count)
    parts = scratch.settle(components(links, scratch, size["n"]), "parts")
    turn = 0
    while turn <= _ROUNDS:
        part_of = members.join(parts, members["rep"] == parts["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("part"))
        centres = _centres(links, parts)
        last = turn == _ROUNDS
        found = _across(part_of, centres, sets, percent, scratch) if last else _confirm(_stars(part_of, centres), sets, percent)
        found, size = scratch.measured(found, "links", count)
        if not size["n"]:
            turn = _ROUNDS + 1 if last else _ROUNDS
        else:
            links, turn = links.unionByName(found.select("a", "b")), turn + 1
            parts = _joined(parts, found.select(F.col("p").alias("a"), F.col("q").alias("b")), size["n"], scratch)
    whole = classes.join(parts, classes["class"] == parts["node"], "left").select("class", "first", F.coalesce("component", "class").alias("part"))
    least = whole.groupBy("part").agg(F.min("first").alias("component"))
    owner = settle(whole.join(least, "part").select("class", "component"), "owners")
    scratch.drop()

    named = features.select("doc_id", "n_shingles", "class").join(owner, "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group, that with the smallest doc_id; one row where rows repeat its doc_id.

    Rows with a null doc_id all stay. Columns keep their names and values, whatever they are called.
    """
    kept = settle(near_duplicates(docs, words, percent).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "kept")
    turn = fresh_name(docs, "turn")
    # merged at every size, as above; rows then stand by doc_id, which the numbering needs too
    once = docs.filter("doc_id IS NOT NULL").hint("merge").join(kept, docs["doc_id"].cast("long") == kept["doc_id"], "left_semi")
    once = once.withColumn(turn, F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))).filter(F.col(turn) == 1)
    return once.drop(turn).unionByName(docs.filter("doc_id IS NULL"))
