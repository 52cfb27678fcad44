"""Stances learned from judgements, against a plain loop and held-out documents."""

import glob
import math
import re

import pytest
from pyspark.sql import functions as F

from pressloom.operators import stances
from pressloom.plans.articles import articles, sentiment

DOCS = [
    ("a", "War crimes and lies, lies about Kiev"), ("b", "A fine and peaceful accord in Paris"), ("c", "Weather report: rain in Paris"), ("d", "Lies and crimes again, Kiev says"),
    ("e", "Peaceful accord, fine weather"), ("f", None), ("g", ""), ("h", "Kiev " * 30), ("i", "zzz unknown Paris"), ("j", "?! 12"),
]
JUDGED = [("a", "x", "anti"), ("a", "y", "anti"), ("b", "x", "pro"), ("c", "x", "neutre"), ("e", "x", "pro"), ("d", "x", "non_concerne"), ("f", "x", "anti"), ("gone", "x", "pro"), (None, "x", "pro"), ("b", "y", None)]
TARGETS = {"ukraine": "Kiev", "france": "(?i)paris"}


def plain(docs, judged, words, evidence):
    """stance, lean, score by document and target."""
    tokens = lambda text: set(re.findall(r"[a-z][a-z\-']{2,}", (text or "").lower()))
    text = dict(docs)
    counts, docs_of = {}, dict.fromkeys(stances.STANCES, 0)
    for a, _, s in judged:
        if s in stances.STANCES and text.get(a) is not None:
            docs_of[s] += 1
            for w in tokens(text[a]):
                counts.setdefault(w, dict.fromkeys(stances.STANCES, 0))[s] += 1
    n = sum(docs_of.values())
    rate = {w: sum(c.values()) / n for w, c in counts.items()}
    g = {w: round(2 * sum(x * math.log(x / (docs_of[s] * rate[w])) for s, x in c.items() if x), 9) for w, c in counts.items()}
    kept = sorted((w for w in counts if g[w] > evidence), key=lambda w: (-g[w], w))[:words]
    out = {}
    for d, t in docs:
        fit = {s: math.log((docs_of[s] + 0.5) / (n + 1.5)) + sum(math.log((counts[w][s] + 2 * rate[w]) / (docs_of[s] + 2)) - math.log(rate[w]) for w in tokens(t) if w in kept) for s in stances.STANCES}
        best = max(fit.values())
        p = {s: math.exp(v - best) for s, v in fit.items()}
        for name, pattern in TARGETS.items():
            hits = len(re.findall(pattern, t or ""))
            stance = min((round(-v, 9), s) for s, v in fit.items())[1]
            out[d, name] = (stance, round((p["pro"] - p["anti"]) / sum(p.values()), 6), min(1.0, hits / 10)) if hits else ("non_concerne", 0.0, 0.0)
    return out


def scored(spark, docs, judged, **how):
    df = spark.createDataFrame([(*d, 1) for d in docs], "id string, content string, token int")
    votes = spark.createDataFrame(judged, "article_id string, target string, stance string")
    rows = stances.stance_rows(df, stances.learned(df, votes, **how), TARGETS).collect()
    assert len(rows) == len(docs) * len(TARGETS)
    return {(r.article_id, r.target): (r.stance, round(r.lean, 6), r.score) for r in rows}


@pytest.mark.parametrize(("words", "evidence"), [(1000, 0.0), (4, 0.0), (1000, 3.0)])
def test_equals_a_plain_loop(spark, words, evidence):
    got = scored(spark, DOCS, JUDGED, words=words, evidence=evidence)
    assert got == plain(DOCS, JUDGED, words, evidence)
    assert got["h", "ukraine"][2] == 1.0 and got["f", "ukraine"] == ("non_concerne", 0.0, 0.0)


def test_without_judgements_or_documents(spark):
    got = scored(spark, DOCS, [])
    assert got["a", "ukraine"] == ("anti", 0.0, 0.1) and got["b", "ukraine"] == ("non_concerne", 0.0, 0.0)  # ties: first by name
    assert scored(spark, [], JUDGED) == {}


@pytest.mark.skipif(not glob.glob("/root/testdata/sf0.1/labels.parquet"), reason="no test tables")
def test_held_out_judgements(spark):
    """More stances of documents that it didn't learn from are told right than by the commonest one, and most of the rare 'anti'."""
    sf = "/root/testdata/sf0.1"
    a, s = articles(spark, sf), sentiment(spark, sf).filter("stance <> 'non_concerne'")
    rows = stances.stance_rows(a, stances.learned(a, s.filter("doc_id % 5 <> 0")), {"any": "(?s)^."}).select("article_id", F.col("stance").alias("told"))
    held = s.filter("doc_id % 5 = 0").select("article_id", "stance").distinct().join(rows, "article_id").filter("told <> 'non_concerne'")
    got = held.agg(F.avg((F.col("told") == F.col("stance")).cast("double")).alias("right"), F.count("*").alias("n"), F.sum(((F.col("stance") == "anti") & (F.col("told") == "anti")).cast("int")).alias("anti"), F.count_if(F.col("stance") == "anti").alias("of"), F.avg((F.col("stance") == "pro").cast("double")).alias("common")).first()
    assert got["n"] > 500 and got["right"] > got["common"] + 0.04 and got["anti"] * 2 > got["of"]
