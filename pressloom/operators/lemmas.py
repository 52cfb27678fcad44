"""Lemmas of words: a dictionary of whole words first, then suffix rules learned from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.operators.lexical import lemmatised


def suffix_rules(pairs: DataFrame, context: int = 4, least: int = 2) -> DataFrame:
    """suffix, to, n: what words that end so end in as lemmas, from pairs (word, lemma).

    A pair gives the ending in which its two sides differ, and the same with one
    to `context` letters before it. Of a suffix's endings the commonest is kept
    (ties: first in order), if `least` pairs at least have it.
    """
    known = pairs.select("word", "lemma").dropna().distinct()
    shared = F.size(F.filter(F.sequence(F.lit(0), F.least(F.length("word"), F.length("lemma"))), lambda i: F.substring("word", F.lit(1), i) == F.substring("lemma", F.lit(1), i))) - 1
    ends = known.withColumn("shared", shared).withColumn("at", F.explode(F.expr(f"sequence(shared, greatest(shared - {context}, 0), -1)")))
    by = ends.select(F.expr("substring(word, at + 1)").alias("suffix"), F.expr("substring(lemma, at + 1)").alias("to")).groupBy("suffix", "to").agg(F.count("*").alias("n"))
    best = by.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("minus"), "to")).alias("best"))
    return best.select("suffix", "best.to", (-F.col("best.minus")).alias("n")).filter(F.col("n") >= least)


def lemmas(words: DataFrame, rules: DataFrame) -> DataFrame:
    """word, lemma of each distinct word: its longest suffix that has a rule goes for what the rule says; without a rule it stays.

    Each distinct word meets the rules in as many rows as it has suffixes; the
    empty suffix, which all words have, is a rule of its own and no key.
    """
    distinct = words.select("word").dropna().distinct()
    cut = distinct.withColumn("size", F.explode(F.sequence(F.lit(1), F.length("word")))).filter("word <> ''")
    hit = cut.select("word", "size", F.expr("substring(word, length(word) - size + 1)").alias("suffix")).join(rules.select("suffix", "to"), "suffix")
    best = hit.groupBy("word").agg(F.max(F.struct("size", "to")).alias("best"))
    other = rules.filter("suffix = ''").agg(F.coalesce(F.max("to"), F.lit("")).alias("other"))  # one row
    lemma = F.when(F.col("best").isNotNull(), F.concat(F.expr("substring(word, 1, length(word) - best.size)"), "best.to")).otherwise(F.concat("word", "other"))
    return distinct.join(best, "word", "left").crossJoin(F.broadcast(other)).select("word", lemma.alias("lemma"))


def lemmatise(tokens: DataFrame, dictionary: DataFrame, context: int = 4, least: int = 2) -> DataFrame:
    """tokens (token and whatever else) with each token's lemma in its place: the dictionary's (word, lemma; of several the first in order), else by the rules learned from it.

    Distinct tokens alone meet the dictionary and the rules. Null and empty
    tokens stay as they are.
    """
    known = dictionary.dropna(subset=["word", "lemma"]).groupBy("word").agg(F.min("lemma").alias("lemma"))
    distinct = tokens.select(F.col("token").alias("word")).distinct()
    rest = lemmas(distinct.join(known, "word", "left_anti"), suffix_rules(known, context, least))
    return lemmatised(tokens, known.unionByName(rest.filter("word <> ''")))
