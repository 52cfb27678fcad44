"""Term tracking and distinctive vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions.columns import period, share
from pressloom.operators.filters import matches

# Patterns that readers follow, by category.
FRAMING = {
    "Monde russe": r"русск(ий|ого|ому|им|ом) мир",
    "Étranger proche": r"ближн(ее|его|ему|им|ем) зарубежь",
    "Régime de Kiev": r"киевск(ий|ого|ому|им|ом) режим",
    "Dénazification": r"денацифи",
    "Démilitarisation": r"демилитариз",
    "Russophobie": r"русофоб",
    "Neonazisme / Bandera": r"неонацист|необандер|бандеровц|бандеровск",
    "Occident collectif (lexical)": r"коллективн(ый|ого|ому|ым|ом) запад",
    "Genocide du Donbass": r"геноцид.{0,15}донбасс",
    "Junte illegitime": r"хунт|нелегитимн",
}
INDICATORS = {
    "Mobilisation": r"мобилизац|уклонист|военкомат|призывник|повестк[а-я]* в военкомат|электронн[а-я]* повестк|вручил[а-я]* повестк|реестр повесток",
    "Signaux de negociation": r"переговор|перемири|мирн[а-я]* план|урегулировани|прекращени[ея] огня",
    "Stress économique interne": r"дефицит бюджет|бюджетн[а-я]* дефицит|инфляц|девальвац",
}
#: A lexicon for corpora without Russian.
STEMS = {"tion": "tion", "ment": "ment", "ung": "ung", "ción": "ción", "sanct": "sanct"}

TOKEN = r"[a-zA-Zа-яёА-ЯЁ][a-zA-Zа-яёА-ЯЁ\-']{2,}"
# Spoken particles, taken out before texts are embedded.
ORAL = ["вот", "ну", "ага", "угу", "короче", "типа", "тип", "мол", "как бы", "в общем", "собственно", "значит", "наверное", "кстати", "реально", "вообще", "как-то", "что-то", "какой-то", "какая-то", "какое-то", "прямо", "слушайте", "понимаете", "знаете", "так сказать", "это самое", "да ладно", "действительно", "конечно", "просто"]


def without_particles(text: Column) -> Column:
    return F.regexp_replace(text, r"(?iU)\b(?:" + "|".join(sorted(ORAL, key=len, reverse=True)) + r")\b", " ")


def term_overview(df: DataFrame, lexicon: dict[str, str], category: str = "stem") -> DataFrame:
    """category, term, articles, pct: every term counted in one pass."""
    names = list(lexicon)
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(matches(lexicon[t])).alias(f"t{i}") for i, t in enumerate(names)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("articles")) for i, t in enumerate(names)]))
    return counts.select("total", rows.alias("r")).select(F.lit(category).alias("category"), "r.term", "r.articles", share(F.col("r.articles"), F.col("total")).alias("pct"))


def term_over_time(df: DataFrame, pattern: str, grain: str) -> DataFrame:
    by = df.filter("published_at IS NOT NULL").groupBy(period(F.col("published_at"), grain).alias("period")).agg(F.count("*").alias("total"), F.count_if(matches(pattern)).alias("n"))
    return by.withColumn("pct", share(F.col("n"), F.col("total")))


def term_by_source(df: DataFrame, pattern: str, least: int = 5) -> DataFrame:
    by = df.groupBy("source_name", "type_media").agg(F.count("*").alias("total"), F.count_if(matches(pattern)).alias("n"))
    return by.filter((F.col("total") >= least) & (F.col("n") > 0)).withColumn("pct", share(F.col("n"), F.col("total")))


def tokens(text: Column, stopwords: list[str] = ()) -> Column:
    """Lower-case words of three letters or more, ё as е, without stopwords."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    plain = F.transform(found, lambda w: F.replace(w, F.lit("ё"), F.lit("е")))
    return F.filter(plain, lambda w: ~w.isin(list(stopwords))) if stopwords else plain


def lemmatised(words: DataFrame, lemmas: DataFrame | None) -> DataFrame:
    """word replaced by its lemma where the dictionary (word, lemma) has one; distinct words meet the dictionary, not every occurrence."""
    if lemmas is None:
        return words
    known = words.select("token").distinct().join(lemmas.select(F.col("word").alias("token"), "lemma"), "token")
    return words.join(known, "token", "left").withColumn("token", F.coalesce("lemma", "token")).drop("lemma")


def axis_words(by: DataFrame) -> DataFrame:
    """axe, token, all_n: the union of an axis's vocabularies, each word with its count in all groups."""
    return by.groupBy("axe", "token").agg(F.sum("n").alias("all_n"))


def vocabulary(words: DataFrame) -> DataFrame:
    """axe, v, axis_n: distinct words and occurrences."""
    return words.groupBy("axe").agg(F.count("*").alias("v"), F.sum("all_n").alias("axis_n"))


def divergence(counts: DataFrame, alpha: float = 0.5, least: int = 8, sources: int = 3, most: int = 60, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """axe, groupe, token, contribution, freq_groupe, freq_reste, n_groupe, rang: words that set a group apart from the rest of its axis.

    counts: axe, groupe, source, token, n. A word's part in KL(group || rest),
    Laplace smoothed over the axis's vocabulary, kept where it is positive, often
    enough used, and by several sources (fewer where the group has fewer). A
    group alone on its axis is left out. counts are read twice, words three times:
    keep settles the words, axis_counts the counts.
    """
    by = counts.groupBy("axe", "groupe", "token", "source").agg(F.sum("n").alias("n")).groupBy("axe", "groupe", "token").agg(F.sum("n").alias("n"), F.count("source").alias("s"))
    by = keep(by, "words")
    word = axis_words(by)
    group = by.groupBy("axe", "groupe").agg(F.sum("n").alias("group_n")).join(counts.groupBy("axe", "groupe").agg(F.countDistinct("source").alias("group_s")), ["axe", "groupe"]).join(vocabulary(word), "axe").filter("axis_n > group_n")
    rows = by.filter(F.col("n") >= least).join(F.broadcast(group), ["axe", "groupe"]).filter(F.col("s") >= F.least(F.lit(sources), F.col("group_s"))).join(word, ["axe", "token"])
    p = (F.col("n") + alpha) / (F.col("group_n") + alpha * F.col("v"))
    q = (F.col("all_n") - F.col("n") + alpha) / (F.col("axis_n") - F.col("group_n") + alpha * F.col("v"))
    rows = rows.withColumn("p", p).withColumn("q", q).withColumn("contribution", F.round(F.col("p") * F.ln(F.col("p") / F.col("q")), 9)).filter("contribution > 0")
    rank = F.row_number().over(Window.partitionBy("axe", "groupe").orderBy(F.desc("contribution"), "token"))
    return rows.withColumn("rang", rank).filter(F.col("rang") <= most).select("axe", "groupe", "token", "contribution", F.round(F.col("p") * 10000, 6).alias("freq_groupe"), F.round(F.col("q") * 10000, 6).alias("freq_reste"), F.col("n").alias("n_groupe"), "rang")


def axis_counts(df: DataFrame, stopwords: list[str] = (), keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """axe, groupe, source, token, n for both axes; words are counted by source before they are dealt to axes. keep settles those counts, a row a source and word, so that texts are taken apart once."""
    words = df.select("source_name", "type_media", "source_kind", F.explode(tokens(F.col("content"), stopwords)).alias("token"))
    n = words.groupBy("source_name", "type_media", "source_kind", "token").agg(F.count("*").alias("n"))
    n = keep(n, "counts")
    axes = F.explode(F.array(F.struct(F.lit("type_media").alias("axe"), F.col("type_media").alias("groupe")), F.struct(F.lit("source_kind").alias("axe"), F.col("source_kind").alias("groupe"))))
    return n.select(axes.alias("x"), F.col("source_name").alias("source"), "token", "n").select("x.axe", "x.groupe", "source", "token", "n")


def ctfidf(rows: DataFrame, most: int = 10) -> DataFrame:
    """topic, token, weight: class-based tf-idf, the keywords of each topic."""
    n = rows.groupBy("topic", "token").agg(F.count("*").alias("n"))
    word = n.groupBy("token").agg(F.sum("n").alias("f"))
    total = n.groupBy("topic").agg(F.sum("n").alias("t"))
    mean = total.agg(F.avg("t").alias("a"))
    w = n.join(word, "token").join(total, "topic").crossJoin(F.broadcast(mean)).withColumn("weight", F.round(F.col("n") / F.col("t") * F.ln(1 + F.col("a") / F.col("f")), 9))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "token"))
    return w.withColumn("rank", rank).filter(F.col("rank") <= most).select("topic", "token", "weight", "rank")


