import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pressloom.llm import packing
from pressloom.llm.textkit import Encoder
from pressloom.llm.token_files import crc_of
from tests.llm.helpers import awkward, empty

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def fewest(sizes, capacity):
    """Exact, by the states that bins can be in."""
    sizes = sorted(sizes, reverse=True)

    @lru_cache(None)
    def put(i, gaps):
        if i == len(sizes):
            return 0
        best = 1 + put(i + 1, tuple(sorted([*gaps, capacity - sizes[i]])))
        for k, g in enumerate(gaps):
            if g >= sizes[i] and (k == 0 or gaps[k - 1] != g):
                best = min(best, put(i + 1, tuple(sorted([*gaps[:k], g - sizes[i], *gaps[k + 1 :]]))))
        return best

    return put(0, ())


def check(bins, counts, capacity):
    used = {}
    for filling, many in bins:
        assert many > 0 and sum(s * n for s, n in filling) <= capacity
        for s, n in filling:
            used[s] = used.get(s, 0) + n * many
    assert used == {s: c for s, c in counts.items() if c}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_plan_is_optimal_on_small_cases(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    bins = packing.plan_bins(counts, 20).bins
    check(bins, counts, 20)
    assert sum(m for _, m in bins) == fewest(tuple(sizes), 20)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_optimal_on_hard_lengths(seed):
    """Just over a third and a half of the capacity, and between a quarter and a half."""
    rng = random.Random(seed)
    low, high = [(650, 1060), (683, 760), (520, 1030), (400, 1100)][seed % 4]
    sizes = [rng.randint(low, high) for _ in range(9)]
    counts = {s: sizes.count(s) for s in sizes}
    bins = packing.plan_bins(counts, 2048).bins
    check(bins, counts, 2048)
    assert sum(m for _, m in bins) == fewest(tuple(sizes), 2048) >= packing.lower_bound(counts, 2048)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_lower_bound_is_one(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    assert -(-sum(sizes) // 20) <= packing.lower_bound(counts, 20) <= fewest(tuple(sizes), 20)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 14))
def test_fillings_are_lazy_fullest_first_and_complete(counts, room):
    """Some filling among them is as full as any, they come by fullness, and none comes twice."""
    got = list(packing._fillings(counts, room))
    sums = [sum(s * n for s, n in f) for f in got]
    assert sums == sorted(sums, reverse=True) and len({tuple(sorted(f)) for f in got}) == len(got)
    reach = {0}
    for s, c in counts.items():
        reach = {r + s * n for r in reach for n in range(c + 1) if r + s * n <= room}
    assert sums[0] == max(reach)


def test_plan_of_many_pieces_is_tight():
    rng = random.Random(3)
    counts = {}
    for _ in range(20_000):
        s = min(2048, int(rng.lognormvariate(6, 1)) + 1)
        counts[s] = counts.get(s, 0) + 1
    bins = packing.plan_bins(counts).bins
    check(bins, counts, 2048)
    assert sum(m for _, m in bins) <= -(-sum(s * c for s, c in counts.items()) // 2048) + 1
    check(packing.best_fit(counts, 2048), counts, 2048)


def test_plans_come_from_bin_completion():
    """The first descent where it meets the bound (best fit needs more), the search where neither it nor best fit is enough; best fit alone only as an incumbent."""
    rng = np.random.default_rng(1)
    sizes, many = np.unique(np.clip(rng.lognormal(5.5, 1, 100_000).astype(int) + 1, 1, 2048), return_counts=True)
    counts = dict(zip(sizes.tolist(), many.tolist(), strict=True))
    plan = packing.plan_bins(counts)
    check(plan.bins, counts, 2048)
    assert plan.found_by == "descent" and plan.size == plan.least < sum(m for _, m in packing.best_fit(counts, 2048))
    found = []
    for seed in range(40):
        rnd = random.Random(seed)
        counts = {}
        for _ in range(30):
            s = rnd.randint(520, 1030)
            counts[s] = counts.get(s, 0) + 1
        plan, descent, fit = packing.plan_bins(counts), packing.plan_bins(counts, nodes=0), sum(m for _, m in packing.best_fit(counts, 2048))
        check(plan.bins, counts, 2048)
        assert plan.least <= plan.size <= descent.size <= fit
        assert (plan.found_by == "search") == (plan.size < descent.size) and (descent.found_by == "best fit" or descent.size <= fit)
        found.append(plan.found_by)
    assert found.count("search") > 3 and found.count("descent") > 3
    assert packing.plan_bins({}).size == 0


def test_pack_holds_its_contract(spark):
    docs = awkward(spark, [(100 + i, "some words here " * (i * 37 % 90), "en", "d", 1, 1.0, "x") for i in range(120)])
    rows = [r.asDict() for r in packing.pack(docs, VOCABULARY).collect()]
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    want = sorted(str((d["doc_id"], k // 2048, k, len(ids[k : k + 2048]), crc_of(ids[k : k + 2048]))) for d in docs.collect() for ids in [np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 0])] for k in range(0, len(ids), 2048))
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert {(r["found_by"], r["over_bound"]) for r in rows} == {("descent", 0)}
    assert packing.pack(empty(spark), VOCABULARY).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_tokenizer(name):
    texts = ["", "  ", "a..b", "Hello,, world.  x\t y\n\n z", "it's I'll don't", "x_. y", "naïve café. Ünï, ΣΑΣ. İstanbul, \x1c.\x1f", "a .b , c", "<|endoftext|> hi <|startoftext|>", "tail \n", " lead", ".start", "1,000.50", "é. x", "日本語。テスト, abc.", "\x00a. b", "é. x", "a \tb  c"]
    rng = random.Random(1)
    texts += ["".join(rng.choice(" \n\t.,!aBé9_'Σ") for _ in range(40)) for _ in range(400)]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    for x, got in zip(texts, Encoder(public_tokenizers.path(name), most=50)(texts), strict=True):
        assert got.tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
