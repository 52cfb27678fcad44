import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from pressloom.llm import linear, quality, toxicity
from tests.llm.helpers import awkward, empty


def corpus(spark, n=700):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        ws = [rng.choice("river stone morning letter window garden yellow market people number".split()) for _ in range(60)]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            ws[10] = ws[30] = "scum"
        text = " ".join(w.upper() + "!!" for w in ws) if bad else " ".join(ws).capitalize() + "."
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def accuracy(got, labels, k):
    truth = {x[0]: x[k] for x in labels}
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    q = quality.quality_scores(docs, labels).collect()
    t = toxicity.toxicity_scores(docs, labels).collect()
    assert accuracy(q, truth, 1) > 0.97 and accuracy(t, truth, 2) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in q)


def test_held_out_labels_teach_nothing(spark):
    docs, labels, _ = corpus(spark, 300)
    wrong = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality.quality_scores(docs, labels).collect())) == sorted(map(tuple, quality.quality_scores(docs, wrong).collect()))


def test_awkward_documents_and_labels(spark):
    docs, labels, _ = corpus(spark, 300)
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        got = scores(awkward(spark), labels.unionByName(odd)).collect()
        assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1  # empty texts: the bias
        assert scores(empty(spark), labels).count() == 0
        assert {r["score"] for r in scores(awkward(spark), labels.limit(0)).collect()} == {0.5}


def test_keep_good_keeps_columns(spark):
    docs, labels, truth = corpus(spark)
    kept = quality.keep_good(docs, labels)
    good = {x[0] for x in truth if x[1]}
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and good <= ids and len(ids - good) < 5


def plain_ftrl(rows, s, order):
    """FTRL-proximal coordinate by coordinate, in dictionaries: rows are (features by place, label), order their numbers by epoch."""
    z, n, bias = {}, {}, 1 << s.bits

    def weight(i):
        l1 = 0 if i == bias else s.l1
        a = z.get(i, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    for numbers in order:
        for k in numbers:
            x, y = rows[k]
            x = {**x, bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v * (s.positive_weight if y else 1.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i))}


def test_queries_equal_a_plain_loop(spark):
    """Training in Spark and scoring against dictionaries on one machine: same sample, order, steps and scores."""
    docs, labels, truth = corpus(spark, 160)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for module, label, scores, column in ((quality, "quality", quality.quality_scores, 1), (toxicity, "toxic", toxicity.toxicity_scores, 2)):
        s = module.SETTINGS
        x = {d: dict(zip(i.tolist(), np.float32(v).astype(float).tolist())) for d, (i, v) in ((d, module.features(t, s.bits)) for d, t in text.items())}
        keys = [F.xxhash64("doc_id", F.lit(31 + e)).alias(f"h{e}") for e in range(s.epochs)]
        draws = [r for r in docs.select("doc_id", *keys).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
        order = [[r["doc_id"] for r in sorted(draws, key=lambda r: r[f"h{e}"])] for e in range(s.epochs)]
        want = plain_ftrl({r[0]: (x[r[0]], r[column]) for r in truth}, s, order)
        got = linear.train(docs, labels, label, module.features, s)
        assert {i: round(float(w), 6) for i, w in enumerate(got) if round(float(w), 6)} == {i: round(w, 6) for i, w in want.items() if round(w, 6)}
        for r in scores(docs, labels).collect():
            p = 1 / (1 + math.exp(-sum(want.get(i, 0.0) * v for i, v in x[r["doc_id"]].items()) - want.get(1 << s.bits, 0.0)))
            assert abs(r["score"] - p) < 1e-4 and r["predicted"] == (r["score"] >= module.THRESHOLD)


def test_long_texts_can_be_learned_from(spark):
    docs, labels, _ = corpus(spark, 120)
    long = spark.createDataFrame([(1000, "scum river " * 200_000), (1001, "x" * 1_000_000)], "doc_id long, text string")
    more = spark.createDataFrame([(1000, 0, 1), (1001, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(docs.unionByName(long), labels.unionByName(more)).count() == 122
