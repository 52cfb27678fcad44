"""The language of a text, by sums of log-likelihoods of its character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.sources.sinks import settled

#: Rows of profiles (a language and one of its n-grams) that are broadcast at most, and numbers in their table of n-grams by languages; larger ones are joined.
FEW, CELLS = 1 << 20, 1 << 22
#: Characters whose words are counted at a time.
CHUNK = 1 << 22


def grams(word: Column, n: int = 3) -> Column:
    """Every window of n characters of the word with a blank at either end; in time proportional to its length."""
    chars = F.split(F.concat(F.lit(" "), word, F.lit(" ")), "")
    return F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))


def _plain(text: Column) -> Column:
    """The lower-cased words (runs of letters), a blank between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))


def _taken_apart(words: list[str], n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct grams() of the words, the place among them of each window, and the place of its word."""
    text, size = " " + "  ".join(words) + " ", np.array([len(w) + 2 for w in words], np.int64)
    chars, word = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64), np.repeat(np.arange(len(words)), size)
    last = max(len(chars) - n + 1, 0)
    start = np.flatnonzero((word[:last] == word[n - 1 : n - 1 + last]) & (size[word[:last]] > 2))
    key = chars[start]
    for i in range(1, n):
        if i > 2:  # three code points of 21 bits fit
            key = pd.factorize(key)[0]
        key = key << 21 | chars[start + i]
    at, distinct = pd.factorize(key)
    first = np.zeros(len(distinct), np.int64)
    first[at] = start
    return [text[i : i + n] for i in first.tolist()], at, word[start]


def _chunks(texts: pd.Series) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, int]]:
    """Distinct words, the place among them of each word of the texts, the place of that word's text, and how many texts, a chunk of texts at a time."""
    for _, part in texts.groupby((texts.str.len().cumsum() // CHUNK).to_numpy()):
        words = pc.split_pattern(pa.array(part, pa.string()), " ")
        spelled = words.flatten().dictionary_encode()
        yield spelled.dictionary.to_pylist(), spelled.indices.to_numpy(), np.repeat(np.arange(len(part)), pc.list_value_length(words).to_numpy()), len(part)


def _by_language(texts: DataFrame, language: str, text: str, n: int) -> DataFrame:
    """language, gram, n: n-grams of the labelled texts; equal words of a batch are counted first and taken apart once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                for words, places, _, _ in _chunks(rows["plain"]):
                    found, at, word = _taken_apart(words, n)
                    counts = np.bincount(at, weights=np.bincount(places, minlength=len(words))[word], minlength=len(found))
                    if found:
                        yield pd.DataFrame({"lang": lang, "gram": found, "n": counts.astype(np.int64)})

    schema = f"lang {texts.schema[language].dataType.simpleString()}, gram string, n long"
    made = texts.select(F.col(language).alias("lang"), _plain(F.col(text)).alias("plain")).mapInPandas(count, schema)
    return made.groupBy(F.col("lang").alias(language), "gram").agg(F.sum("n").alias("n"))


def _counted(texts: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, gram, n: n-grams of each text; equal words are counted first and taken apart once."""
    words = texts.select(key, F.explode(F.split(_plain(F.col(text)), " ")).alias("word")).filter("word <> ''").groupBy(key, "word").agg(F.count("*").alias("n"))
    return words.select(key, "n", F.explode(grams(F.col("word"), n)).alias("gram")).groupBy(key, "gram").agg(F.sum("n").alias("n"))


def profiles(texts: DataFrame, text: str = "text", language: str = "lang", n: int = 3, alpha: float = 0.5) -> DataFrame:
    """language, gram, weight: how much each n-gram of the labelled texts speaks for each language, and a row with a null gram for all others.

    weight: log((count + alpha) / (total + alpha * (grams + 1))), over all texts;
    a language that lacks a gram that another has is left to the null row. Texts
    without a language are left out.
    """
    by = settled(_by_language(texts.filter(F.col(language).isNotNull()), language, text, n), "grams")  # else texts are read again for each sum
    total = by.groupBy(language).agg(F.sum("n").alias("total"))
    size = by.agg(F.countDistinct("gram").alias("grams"))
    totals = total.crossJoin(F.broadcast(size))  # a row for each language
    weight = lambda count: F.log((count + alpha) / (F.col("total") + alpha * (F.col("grams") + 1)))
    seen = by.join(F.broadcast(totals), language).select(F.col(language).alias("language"), "gram", weight(F.col("n")).alias("weight"))
    return seen.unionByName(totals.select(F.col(language).alias("language"), F.lit(None).cast("string").alias("gram"), weight(F.lit(0)).alias("weight")))


def identified(texts: DataFrame, known: DataFrame, key: str, text: str = "text", n: int = 3) -> DataFrame:
    """key, language, score (log-likelihood a gram) of each text: the language whose profile its n-grams fit best (ties: first by name).

    Profiles of FEW rows at most are broadcast, and a text stays where it is: its
    words are summed up in its batch, only sums cross the network. Larger ones are
    met by a join. Grams that no profile has weigh alike by language. A text
    without letters or without a key has no row; keys must be unique.
    """
    texts = texts.filter(F.col(key).isNotNull())
    rows = known.select("language", "gram", "weight").limit(FEW + 1).toArrow().to_pandas()
    names, places = sorted(rows["language"].unique()), sorted(rows["gram"].dropna().unique())
    if not names or len(rows) > FEW or len(names) * len(places) > CELLS:
        return _joined(texts, known, key, text, n)
    rest = rows[rows["gram"].isna()].set_index("language")["weight"]
    seen, at = rows[rows["gram"].notna()], {g: i for i, g in enumerate(places)}
    more = np.zeros((len(names), len(places) + 1))  # the last for all other grams
    more[seen["language"].map({x: i for i, x in enumerate(names)}), seen["gram"].map(at)] = seen["weight"] - seen["language"].map(rest)
    shared = texts.sparkSession.sparkContext.broadcast((at, more))

    @F.pandas_udf("array<double>")
    def sums(plain: pd.Series) -> pd.Series:
        """How many grams a text has, and each language's gain."""
        at, more = shared.value
        out = []
        for words, codes, of, texts in _chunks(plain):
            found, place, word = _taken_apart(words, n)
            of_found = more[:, np.array([at.get(g, -1) for g in found], np.int64)]
            columns = [np.bincount(word, minlength=len(words)), *(np.bincount(word, weights=x[place], minlength=len(words)) for x in of_found)]
            out += [*np.stack([np.bincount(of, weights=x[codes], minlength=texts) for x in columns], axis=1)]
        return pd.Series(out)

    total = texts.select(key, sums(_plain(F.col(text))).alias("sums")).groupBy(key).agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"sum{i}") for i in range(len(names) + 1)])
    scores = [F.struct((-F.round(F.lit(float(rest[x])) + F.col(f"sum{i}") / F.col("sum0"), 9)).alias("minus"), F.lit(x).alias("language")) for i, x in enumerate(names, 1)]
    best = total.filter("sum0 > 0").select(key, F.array_min(F.array(*scores)).alias("best"))
    return best.select(key, "best.language", (-F.col("best.minus")).alias("score"))


def _joined(texts: DataFrame, known: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """identified() for profiles of any size: a text's distinct grams cross the network once, to the gram's weights in all languages."""
    rest = known.filter("gram IS NULL").select("language", F.col("weight").alias("rest"))
    default = rest.agg(F.sort_array(F.collect_list(F.struct("language", "rest"))).alias("rest"))  # one row, an entry a language
    more = known.filter("gram IS NOT NULL").join(F.broadcast(rest), "language").select("language", "gram", (F.col("weight") - F.col("rest")).alias("more"))
    counts = _counted(texts, key, text, n)
    size = counts.groupBy(key).agg(F.sum("n").alias("size"))
    gains = counts.join(more, "gram").groupBy(key, "language").agg(F.sum(F.col("n") * F.col("more")).alias("gain"))
    every = size.crossJoin(F.broadcast(default)).select(key, "size", F.inline("rest"))
    scored = every.join(gains, [key, "language"], "left").withColumn("score", F.round(F.col("rest") + F.coalesce("gain", F.lit(0.0)) / F.col("size"), 9))
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("minus"), "language")).alias("best"))
    return best.select(key, "best.language", (-F.col("best.minus")).alias("score"))
