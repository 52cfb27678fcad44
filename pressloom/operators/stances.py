"""A scorer learned from stored judgements: stances by the words of a text, in place of a model's reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.operators.lexical import tokens

STANCES = ("anti", "neutre", "pro")
#: Words that a scorer keeps, so that it can be broadcast: 24 bytes and the word for each.
WORDS = 50_000


def _words(text: Column) -> Column:
    return F.array_distinct(F.coalesce(tokens(text), F.expr("CAST(array() AS array<string>)")))


def learned(docs: DataFrame, judged: DataFrame, words: int = WORDS, evidence: float = 20.0) -> DataFrame:
    """token, weights (a number a stance): what a word says for each stance; a row with a null token holds what the stances weigh by themselves.

    docs: id, content; judged: article_id, stance; other stances and documents
    without content teach nothing. A document counts as often as it was judged, a
    word once in a document. A weight is the logarithm of the word's share of the
    stance's documents (two more that hold it at the common share) to its share
    of all. Kept are the words whose counts by stance differ by more than chance
    (G of the likelihood-ratio test above `evidence`), at most `words` with the
    most evidence (ties: first in code-point order). No judgements: no words.
    Judgements are summed up by document before texts are taken apart, words by
    task before they cross the network.
    """
    names = [f"n{i}" for i in range(len(STANCES))]
    votes = judged.filter(F.col("stance").isin(*STANCES)).groupBy(F.col("article_id").alias("id")).agg(*[F.count_if(F.col("stance") == s).alias(n) for s, n in zip(STANCES, names, strict=True)])
    read = docs.select("id", "content").filter("content IS NOT NULL").join(votes, "id")
    total = read.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(f"all_{n}") for n in names]).withColumn("judged", sum(F.col(f"all_{n}") for n in names))
    counts = read.select(F.explode(_words(F.col("content"))).alias("token"), *names).groupBy("token").agg(*[F.sum(n).alias(n) for n in names])
    rates = counts.crossJoin(F.broadcast(total)).withColumn("rate", sum(map(F.col, names)) / F.col("judged"))  # one row
    part = lambda n: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (F.col(f"all_{n}") * F.col("rate")))).otherwise(0.0)
    weight = F.array(*[F.log((F.col(n) + 2 * F.col("rate")) / (F.col(f"all_{n}") + 2)) - F.log("rate") for n in names])
    kept = rates.withColumn("g", F.round(2 * sum(map(part, names)), 9)).filter(F.col("g") > evidence).orderBy(F.desc("g"), "token").limit(words)
    prior = F.array(*[F.log((F.col(f"all_{n}") + 0.5) / (F.col("judged") + 0.5 * len(names))) for n in names])
    return kept.select("token", weight.alias("weights")).unionByName(total.select(F.lit(None).cast("string").alias("token"), prior.alias("weights")))


def stance_rows(docs: DataFrame, known: DataFrame, targets: dict[str, str]) -> DataFrame:
    """article_id, target, stance, score, lean: a row for each document (id, content) and target.

    A target is concerned where its pattern is found; score: a tenth for each
    place, at most 1. Its stance is the one that the text's words are likeliest
    under (ties: first by name), its lean how much likelier 'pro' is than 'anti',
    from -1 to 1. Other targets: 'non_concerne', 0, 0; so is all of a null
    content. Words that the scorer doesn't know say nothing. ids must be unique.

    Texts stay where they are: the scorer is broadcast (WORDS bounds it), and a
    row a document crosses the network.
    """
    names = list(targets)
    hits = F.array(*[F.regexp_count(F.coalesce("content", F.lit("")), F.lit(targets[t])) for t in names])
    once = docs.select("id", hits.alias("hits"), _words(F.col("content")).alias("words"))  # in one select with the explode, hits would be counted again for every word
    each = once.select("id", "hits", F.explode_outer("words").alias("token"))
    said = each.join(F.broadcast(known.filter("token IS NOT NULL")), "token", "left").groupBy("id", "hits").agg(*[F.coalesce(F.sum(F.col("weights")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(len(STANCES))])
    prior = known.filter("token IS NULL").select(F.col("weights").alias("prior"))
    fit = F.array(*[F.round(F.col(f"s{i}") + F.col("prior")[i], 9) for i in range(len(STANCES))])
    rows = said.crossJoin(F.broadcast(prior)).select("id", "hits", fit.alias("fit"))  # one row
    likely = F.transform("fit", lambda x: F.exp(x - F.array_max("fit")))
    lean = (likely[STANCES.index("pro")] - likely[STANCES.index("anti")]) / sum(likely[i] for i in range(len(STANCES)))
    stance = F.element_at(F.array(*map(F.lit, STANCES)), F.array_position("fit", F.array_max("fit")).cast("int"))
    found = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("target"), F.col("hits").alias("n"))).alias("r")
    out = rows.select("id", stance.alias("stance"), lean.alias("lean"), found).withColumn("hit", F.col("r.n") > 0)
    return out.select(
        F.col("id").alias("article_id"), F.col("r.target").alias("target"), F.when(F.col("hit"), F.col("stance")).otherwise("non_concerne").alias("stance"),
        F.least(F.lit(1.0), F.col("r.n") / 10.0).alias("score"), F.when(F.col("hit"), F.col("lean")).otherwise(0.0).alias("lean"),
    )
