"""Best-fit packing: bin completion over the histogram of lengths, then placement of every piece by its rank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.shared import settle, texts
from pressloom.llm.textkit import encoder
from pressloom.llm.token_files import END, crc_of

CAPACITY = 2048
#: Steps that the search takes after its first descent.
NODES = 1000
#: A filling: (length, how many), largest first; and how many sequences are filled that way.
Filling = tuple[tuple[int, int], ...]
Bins = list[tuple[Filling, int]]


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing on a histogram: equal lengths that meet equal gaps are placed together."""
    open_bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            gap = min((g for g in open_bins if g >= size and open_bins[g]), default=None)
            if gap is None:
                each = min(capacity // size, left)
                many = left // each
                open_bins.setdefault(capacity - each * size, []).append(([(size, each)], many))
                left -= each * many
                continue
            filling, many = open_bins[gap].pop()
            each = min(gap // size, left)
            now = min(many, left // each)
            if many > now:
                open_bins[gap].append((filling, many - now))
            open_bins.setdefault(gap - each * size, []).append(([*filling, (size, each)], now))
            left -= each * now
    return [(tuple(f), m) for bins in open_bins.values() for f, m in bins]


def _reach(counts: dict[int, int], sizes: list[int], room: int) -> list[int]:
    """For each i: which sums up to room the first i sizes make, as bits."""
    limit = (1 << (room + 1)) - 1
    reach = [1]
    for s in sizes:
        bits, step, left = reach[-1], 1, min(counts[s], room // s)
        while left:  # counts in binary parts
            now = min(step, left)
            bits |= (bits << (s * now)) & limit
            left -= now
            step *= 2
        reach.append(bits)
    return reach


def _fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths from counts with the largest sum that fits room; of such, the one with the largest lengths."""
    if counts.get(room):
        return [(room, 1)]
    sizes = [s for s in sorted(counts) if counts[s] and s <= room]
    there = np.zeros(room + 1, bool)
    there[sizes] = True
    both = np.flatnonzero(there & there[::-1])  # two lengths that fill room
    for a in both[::-1]:
        b = room - int(a)
        if a > b or a == b and counts[b] > 1:
            return [(int(a), 1), (b, 1)] if a > b else [(b, 2)]
    reach = _reach(counts, sizes, room)
    target, out = reach[-1].bit_length() - 1, []
    for i in range(len(sizes) - 1, -1, -1):
        s = sizes[i]
        for n in range(min(counts[s], target // s), -1, -1):
            if reach[i] >> (target - n * s) & 1:
                if n:
                    out.append((s, n))
                target -= n * s
                break
    return out


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: lengths above half need a bin each; what of the others, down to any threshold, doesn't fit beside these needs more."""
    if not counts:
        return 0
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[int(s)] for s in sizes], np.int64)
    many, total = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * sizes))
    half = int(np.searchsorted(sizes, capacity // 2, "right"))
    best = 0
    low = np.append(0, np.unique(sizes[:half]))
    beside = np.searchsorted(sizes, capacity - low, "right")  # lengths above half that leave room for the threshold
    small = np.searchsorted(sizes, low)
    spare = (many[beside] - many[half]) * capacity - (total[beside] - total[half])
    over = np.maximum(0, total[half] - total[small] - spare)
    best = int((many[-1] - many[half] + -(-over // capacity)).max())
    return max(best, -(-int(total[-1]) // capacity))


def _fillings(counts: dict[int, int], room: int) -> Iterator[list[tuple[int, int]]]:
    """Every filling of room that none dominates, fullest first, made as they are asked for.

    One is left out if some length that it doesn't use could stand for one or two
    of those it uses and fill more (Martello and Toth's rule for one and two). A
    length that fills room alone dominates all others.
    """
    sizes = [s for s in sorted(counts) if counts[s] and s <= room]
    if not sizes or counts.get(room):
        yield [(room, 1)] if sizes else []
        return
    reach = _reach(counts, sizes, room)
    bits = reach[-1]

    def made(i: int, target: int) -> Iterator[list[tuple[int, int]]]:
        if i < 0:
            yield []
            return
        for n in range(min(counts[sizes[i]], target // sizes[i]), -1, -1):
            if reach[i] >> (target - n * sizes[i]) & 1:
                for rest in made(i - 1, target - n * sizes[i]):
                    yield [(sizes[i], n), *rest] if n else rest

    for target in range(room, -1, -1):
        if not bits >> target & 1:
            continue
        gap = room - target
        for filling in made(len(sizes) - 1, target):
            used = dict(filling)
            parts = set(used) | {a + b for a in used for b in used if a < b or a == b and used[a] > 1}
            if not gap or not any(p < s <= p + gap and counts[s] > used.get(s, 0) for p in parts for s in sizes):
                yield filling


def _steps(counts: dict[int, int], capacity: int) -> Iterator[tuple[Filling, int]]:
    """Fillings around the largest length left, each as often as the counts allow and then once."""
    largest = max(counts)
    rest = {s: c for s, c in counts.items() if c > (s == largest)}
    if counts[largest] > 1:
        rest[largest] = counts[largest] - 1
    first = _fullest(rest, capacity - largest)
    yield from _multiples(counts, largest, first)
    for filling in _fillings(rest, capacity - largest):
        if sorted(filling) != sorted(first):
            yield from _multiples(counts, largest, filling)


def _multiples(counts: dict[int, int], largest: int, filling: list[tuple[int, int]]) -> list[tuple[Filling, int]]:
    kinds = {largest: 1}
    for s, n in filling:
        kinds[s] = kinds.get(s, 0) + n
    many = min(counts[s] // n for s, n in kinds.items())
    return [(tuple(kinds.items()), m) for m in dict.fromkeys((many, 1))]


@dataclass
class Plan:
    """Fillings, what found them ('descent' and 'search' of bin completion, or 'best fit'), and the lower bound on bins."""

    bins: Bins
    found_by: str
    least: int

    @property
    def size(self) -> int:
        return sum(m for _, m in self.bins)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Fillings for so many pieces of each length, in as few bins as can be found.

    Bin completion: the largest length left gets a filling around it, fullest
    first, as many times as the counts allow or once, so a few steps place
    however many pieces there are. The first descent, never cut short, gives the
    plan unless best-fit decreasing, the other incumbent, needs fewer bins. Then
    the search goes back step by step through the other undominated fillings,
    leaving out what wastes more than the best known solution allows and what L2
    says can't become better. It ends when a solution meets the lower bound, when
    all is searched (the best is then optimal), or after `nodes` steps, its only
    limit.
    """
    left = {s: c for s, c in counts.items() if c}
    total, least = sum(s * c for s, c in left.items()), lower_bound(left, capacity)
    best, found_by = best_fit(left, capacity), "best fit"
    bins = sum(m for _, m in best)
    frames: list[Iterator] = [_steps(left, capacity)] if left else []
    path: Bins = []
    used = waste = 0
    descending = True
    while frames and (descending or bins > least and nodes > 0):
        if len(path) == len(frames):  # take back this frame's last step
            filling, many = path.pop()
            used, waste = used - many, waste - many * (capacity - sum(s * n for s, n in filling))
            for s, n in filling:
                left[s] = left.get(s, 0) + n * many
        step = next(frames[-1], None)
        if step is None:
            frames.pop()
            continue
        filling, many = step
        gap = capacity - sum(s * n for s, n in filling)
        slack = (bins - 1) * capacity - total - waste
        if not descending and gap * many > slack:
            if gap > slack:  # the others are no fuller
                frames.pop()
            continue
        nodes -= not descending
        path.append(step)
        used, waste = used + many, waste + many * gap
        for s, n in filling:
            left[s] -= n * many
            if not left[s]:
                del left[s]
        if not left:
            if used < bins + descending:
                best, bins, found_by = list(path), used, "descent" if descending else "search"
            descending = False
        elif descending or used + lower_bound(left, capacity) < bins:
            frames.append(_steps(left, capacity))
    return Plan(best, found_by, least)


def _pieces(vocabulary: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        for pdf in batches:
            out = []
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                for d, ids in zip(part["doc_id"], encode(part["text"].tolist()), strict=True):
                    ids = np.append(ids, np.uint32(END))
                    out += [(d, k, start, min(capacity, len(ids) - start), crc_of(ids[start : start + capacity])) for k, start in enumerate(range(0, len(ids), capacity))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and its end id, cut where longer than capacity."""
    return texts(docs).mapInPandas(_pieces(vocabulary, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _slots(bins: Bins) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: at which rank each run of slots starts, its first sequence, its offset."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for filling, many in bins:
        offset = 0
        for size, n in filling:
            for _ in range(n):
                slots.setdefault(size, []).append((taken.get(size, 0), first, offset))
                taken[size] = taken.get(size, 0) + many
                offset += size
        first += many
    return {s: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for s, v in slots.items()}


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs; found_by, over_bound: what found the plan and by how many sequences it misses the lower bound, alike in all rows.

    Only the histogram of lengths (capacity numbers at most) reaches the driver,
    which plans fillings and how often each is used. Each piece has a rank among
    those of its length: its place in a hash bucket of that length plus the
    sizes of the buckets before, so that no length makes one large group. The
    rank decides sequence and offset.

    Null or empty text: one piece with the end id alone. Repeated rows and null
    ids are packed like others, each on its own. Other columns are ignored.
    """
    pieces = settle(cut(docs, vocabulary, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_bins(histogram, capacity)
    slots = _slots(plan.bins)
    buckets = max(1, sum(histogram.values()) // 10_000)
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = placed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "bucket", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = placed.withColumn("inside", inside).join(sizes, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            for size in np.unique(lengths):
                here = np.flatnonzero(lengths == size)
                starts, firsts, offsets = slots[int(size)]
                at = np.searchsorted(starts, ranks[here], "right") - 1
                sequence[here], offset[here] = firsts[at] + ranks[here] - starts[at], offsets[at]
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumns({"found_by": F.lit(plan.found_by), "over_bound": F.lit(plan.size - plan.least).cast("long")})
