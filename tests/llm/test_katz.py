import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pressloom.llm import katz
from pressloom.llm.shared import fold, texts

TEXTS = ["the cat sat on the mat", "the cat ran", "a dog sat on a log", "", None, "The CAT sat", "zebra zebra quagga", "the the the the the the the the dog", "on a log the dog sat\non the mat"]


def docs(spark, n=60):
    rows = [(i, TEXTS[(i * 7 + i // 9) % len(TEXTS)] if i % 11 else f"new{i} words sat on the mat{i}", "x") for i in range(n)]
    return spark.createDataFrame([*rows, (None, "no id here", "y")], "doc_id long, text string, score string"), [*rows, (None, "no id here", "y")]


def tokens(text):
    return [*((text or "").encode().lower().split()), b" end"]


def brute(rows):
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    uni, bi, starts = Counter(), Counter(), 0
    for d, t, _ in rows:
        if not held(d):
            ts = tokens(t)
            uni.update(ts)
            bi.update(zip([b" start", *ts[:-1]], ts, strict=True))
            starts += 1
    n = sum(uni.values())
    numbers = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]
    dw, dp = katz.discounts(numbers(uni)), katz.discounts(numbers(bi))
    mass = lambda c, d: d[c - 1] if c <= katz.K else c - katz.EASE
    p1 = {w: mass(c, dw) / n for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    context = Counter()
    for (v, _), c in bi.items():
        context[v] += c

    def prob(v, w):
        low = p1.get(w, unknown)
        if v not in context:
            return low
        if (v, w) in bi:
            return mass(bi[v, w], dp) / context[v]
        seen = [x for (y, x) in bi if y == v]
        left = 1 - sum(mass(bi[v, x], dp) for x in seen) / context[v]
        return left / (1 - sum(p1[x] for x in seen)) * low

    out = {}
    for d, t, _ in rows:
        ts = tokens(t)
        score = sum(math.log10(prob(v, w)) for v, w in zip([b" start", *ts[:-1]], ts, strict=True))
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (len(uni) + 1))) for w in ts)
        out[d] = (held(d), len(ts), sum(uni[w] > 0 for w in ts), n, base, score)
    return out, prob, uni, context


@pytest.mark.parametrize("buckets", [1, 5])
def test_scores_equal_brute_force(spark, buckets):
    df, rows = docs(spark)
    want, *_ = brute(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in katz.katz_scores(df, buckets=buckets).collect()}
    assert got.keys() == want.keys()
    for d in want:
        assert got[d][:4] == want[d][:4]
        assert got[d][4:] == pytest.approx(want[d][4:], abs=1e-6)


def test_contexts_are_normalised(spark):
    _, prob, uni, context = brute(docs(spark)[1])
    for v in context:
        assert sum(prob(v, w) for w in [*uni, b"never seen"]) == pytest.approx(1)


def test_no_rows_and_no_training(spark):
    df, _ = docs(spark)
    assert katz.katz_scores(df.limit(0)).count() == 0
    only = katz.katz_scores(df.filter("doc_id IS NULL")).collect()
    assert [(r["held_out"], r["train_tokens"], r["score"]) for r in only] == [(True, 0, 0.0)]


def test_long_text_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b " * 50_000), (2, "a b"), (2, "a b"), (3, "b a")], "doc_id long, text string")
    rows = katz.katz_scores(df).collect()
    assert sorted(r["n_tokens"] for r in rows) == [3, 3, 3, 100_001]
    assert all(r["score"] <= 0 for r in rows)


@pytest.mark.parametrize("most", [3, 12, 40])
def test_hot_words_and_bigrams(spark, most):
    """A word with a third of the tokens, bigrams of it, and the end of every text are dealt to several groups; scores stay."""
    lines = [" ".join(("top" if (i + k) % 3 == 0 or (i % 5 == 0 and k % 4) else f"w{(i * k) % 17}") for k in range(i % 9)) for i in range(80)]
    rows = [(i, t, "x") for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(7)
    want, *_ = brute(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in katz.katz_scores(df, buckets=3, most=most).collect()}
    assert got.keys() == want.keys()
    for d in want:
        assert got[d][:4] == want[d][:4]
        assert got[d][4:] == pytest.approx(want[d][4:], abs=1e-6)


def test_no_group_holds_a_whole_hot_word(spark):
    """Of 12000 tokens a third are one word, a ninth one bigram: no group has more than a few times `most`."""
    rng = random.Random(1)
    rows = [(i, " ".join("top" if rng.random() < 0.35 else f"w{rng.randrange(900)}" for _ in range(60))) for i in range(200)]
    df = texts(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("train", fold(F.col("doc_id"), 10) != 0).repartition(40)
    hot, buckets = katz._hot(df, 400, 16)
    assert {h.before is None for h in hot} == {True, False}
    sizes = Counter()
    for r in df.mapInPandas(katz._occurrences(buckets, hot), "bucket int, batch long, blob binary").filter("bucket >= 0").collect():
        sizes[r["bucket"]] += int(katz._spread(r["blob"], "<u8", "<u4", "<u2", "u1")[1].sum())
    assert sum(sizes.values()) == 200 * 61
    assert max(sizes.values()) < 4 * 400
