import os

import pytest

import corpus_pipeline
from pressloom.llm import mixing, neardup, quality, rules
from tests.llm.helpers import awkward, empty

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "mixing", "packing"]
    want = {r["doc_id"] for r in quality.quality_scores(docs, labels).filter("predicted = 1").collect()}
    step = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = f(spark, docs, SF)
        assert docs.columns == before.columns
        step[name] = [r["doc_id"] for r in docs.collect()]
        if name == "quality_rules":
            want &= {r["doc_id"] for r in rules.ledger(before).filter(rules.passes(rules.WEB)).collect()}
            assert set(step[name]) == want
        if name == "near_dedup":
            want = {r["doc_id"] for r in neardup.near_duplicates(before, 5, 80).filter("kept").collect()}
            assert sorted(step[name]) == sorted(want)
        if name == "mixing":
            plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(before).collect() if r["copies"]}
            assert {d: step[name].count(d) for d in set(step[name])} == plan
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(step["mixing"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_awkward_and_no_documents(spark):
    """Nulls, empty and long texts, repeated rows, clashing names; each stage by itself and after the others."""
    tables = os.path.join(os.path.dirname(SF), "sf0.001")
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(3000))
    odd = awkward(spark, [(7, long, "en", "a", 1, 1.0, "x"), (7, long, "en", "a", 1, 1.0, "x"), (8, long + " more", "en", "b", 1, None, None)])
    odd = odd.withColumnsRenamed({"extra": "turn", "score": "rule"})
    none = empty(spark).withColumnsRenamed({"extra": "turn", "score": "rule"})
    after, nothing = odd, none
    for name, f in corpus_pipeline.STAGES:
        f(spark, odd, tables).collect()
        after, nothing = f(spark, after, tables), f(spark, nothing, tables)
        assert nothing.count() == 0
        if name != "packing":
            assert after.columns == odd.columns
        if name == "near_dedup":
            assert [r["doc_id"] for r in after.collect()].count(7) <= 1
    after.collect()
