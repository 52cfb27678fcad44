import math

import pytest
from pyspark.sql import functions as F

from pressloom.llm import mixing
from tests.llm.helpers import awkward, empty


def corpus(spark):
    rows = [(i, "word " * (5 + i % 9), "big") for i in range(3000)] + [(3000 + i, "word " * 20, "mid") for i in range(300)] + [(4000 + i, "word " * 11, "small") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def tokens(text):
    return len(text.split())


def test_exponent_meets_targets(spark):
    plan = mixing.mix_plan(corpus(spark), mixing.Target(entropy=0.8, max_passes=None)).cache()
    w = {r["source"]: r["weight"] for r in plan.select("source", "weight").distinct().collect()}
    assert abs(sum(w.values()) - 1) < 1e-9
    assert abs(-sum(x * math.log(x) for x in w.values()) - 0.8 * math.log(3)) < 1e-4
    a = plan.first()["exponent"]
    share = {r["source"]: r["t"] for r in plan.groupBy("source").agg({"tokens": "sum"}).toDF("source", "t").collect()}
    z = sum((t / sum(share.values())) ** a for t in share.values())
    assert all(abs(w[s] - (t / sum(share.values())) ** a / z) < 1e-9 for s, t in share.items())
    limited = mixing.mix_plan(corpus(spark), mixing.Target(entropy=1.0, max_passes=3.0))
    assert abs(max(r["passes"] for r in limited.select("passes").distinct().collect()) - 3.0) < 3e-3  # budgets are whole tokens


def test_exponent_above_one_sharpens(spark):
    rows = [(i, "word " * 10, "abc"[i % 3]) for i in range(300)] + [(1000, "word " * 50, "a")]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.Target(entropy=0.9, max_passes=None)).collect()
    w = {r["source"]: r["weight"] for r in plan}
    assert plan[0]["exponent"] > 1 and w["a"] > w["b"] and abs(w["b"] - w["c"]) < 1e-9
    assert abs(-sum(x * math.log(x) for x in w.values()) - 0.9 * math.log(3)) < 1e-4


@pytest.mark.parametrize("target,budget,block", [(mixing.Target(0.9, 4.0), None, 1000), (mixing.Target(0.5, 4.0), 20_000, 300), (mixing.Target(1.0, None), 90_000, 16_384), (mixing.Target(None, None), None, 100)])
def test_copies_equal_brute_force(spark, monkeypatch, target, budget, block):
    """Budgets, block order, documents' order and copies, row by row."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", block)
    docs = corpus(spark)
    rows = mixing.mix_plan(docs, target, budget, 7).collect()
    total = sum(r["tokens"] for r in rows)
    spend = total if budget is None else budget
    hashed = {r["doc_id"]: (r["b"], r["d"]) for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("b"), F.xxhash64("doc_id", F.lit(9)).alias("d")).collect()}
    turns = {r["id"]: r["t"] for r in spark.range(2000).select("id", F.xxhash64("id", F.lit(8)).alias("t")).collect()}
    seen = set()
    for s in ("big", "mid", "small"):
        own = [r for r in rows if r["source"] == s]
        size = sum(r["tokens"] for r in own)
        share = math.floor(own[0]["weight"] * spend + 1e-6)
        full, rest = divmod(share, size)
        blocks = -(-size // block)
        assert all(r["block"] == hashed[r["doc_id"]][0] % blocks for r in own)
        order = sorted(own, key=lambda r: (turns[r["block"]], r["block"], hashed[r["doc_id"]][1], r["doc_id"]))
        left, stopped, want = rest, False, {}
        for b in dict.fromkeys(r["block"] for r in order):
            inside = [r for r in order if r["block"] == b]
            fits = sum(r["tokens"] for r in inside) <= left
            for r in inside:
                stopped = stopped or not fits and r["tokens"] > left
                want[r["doc_id"]] = full + (not stopped)
                left -= 0 if stopped else r["tokens"]
            stopped = stopped or not fits
        assert {r["doc_id"]: r["copies"] for r in own} == want
        drawn = sum(r["tokens"] * r["copies"] for r in own)
        assert share - max(r["tokens"] for r in own) < drawn <= share
        seen |= {r["copies"] for r in own}
    assert target.entropy is None or len(seen) > 1


def test_mixed_repeats_rows_as_planned(spark):
    docs = corpus(spark)
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {d: c for d, c in plan.items() if c}


def test_awkward_and_empty(spark):
    rows = {(r["doc_id"], r["source"]): r for r in mixing.mix_plan(awkward(spark)).collect()}
    assert rows[1, "a"]["tokens"] == 16 and rows[3, None]["copies"] == 1 and rows[3, None]["weight"] == 0
    assert (None, "b") in rows and len(rows) == 7
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0
    clash = awkward(spark).withColumnsRenamed({"lang": "rule", "n_chars": "Turn", "extra": "rule_source", "score": "copies"})
    out = mixing.mixed(clash, mixing.Target(0.5))
    assert out.columns == clash.columns and out.filter("doc_id = 3").collect() == clash.filter("doc_id = 3").collect()
    one = mixing.mix_plan(awkward(spark).filter("source = 'c'")).collect()
    assert [(r["weight"], r["copies"]) for r in one] == [(1.0, 1)]
