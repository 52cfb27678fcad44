"""Model scorers: an interface that runs in tasks, a lexicon scorer to work offline, and validation of replies."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions.columns import clamp, lenient_json


class Scorer(Protocol):
    """Replies (JSON text, or None for a failure) to a batch of texts."""

    def score(self, texts: list[str]) -> list[str | None]: ...


@dataclass
class LexiconScorer:
    """A deterministic stand-in: a target is concerned where one of its words occurs; its lean counts good against bad words."""

    targets: dict[str, list[str]]
    good: list[str]
    bad: list[str]

    def score(self, texts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for text in texts:
            low = (text or "").lower()
            lean = sum(map(low.count, self.good)) - sum(map(low.count, self.bad))
            stance = "pro" if lean > 0 else "anti" if lean < 0 else "neutre"
            rows = [{"target": t, "stance": stance, "score": min(1.0, sum(map(low.count, ws)) / 10), "lean": max(-1.0, min(1.0, lean / 10))} for t, ws in self.targets.items() if any(w in low for w in ws)]
            out.append(json.dumps({"targets": rows}))
        return out


def replies(docs: DataFrame, make: Callable[[], Scorer]) -> DataFrame:
    """id, reply: a scorer is made once for each task and asked batch by batch; failures are left out, so that the next run retries them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for pdf in batches:
            out = pd.DataFrame({"id": pdf["id"], "reply": scorer.score(pdf["content"].tolist())})
            yield out[out["reply"].notna()]

    return docs.select("id", "content").mapInPandas(run, "id string, reply string")


def sentiment_rows(docs: DataFrame, gate, make: Callable[[], Scorer], targets: list[str], done: DataFrame | None = None) -> DataFrame:
    """article_id, target, stance, score, lean: a row for each document and target.

    Documents without any watched word aren't scored and concern no target.
    done (article_id) holds what earlier runs wrote.
    """
    todo = docs.join(done.select(F.col("article_id").alias("id")).distinct(), "id", "left_anti") if done is not None else docs
    parsed = F.from_json(lenient_json(F.col("reply")), "targets array<struct<target: string, stance: string, score: string, lean: string>>")
    scored = replies(todo.filter(gate), make).select("id", F.map_from_entries(F.transform(F.coalesce(parsed["targets"], F.array()), lambda t: F.struct(t["target"], t))).alias("r"))
    idle = todo.filter(~gate).select("id", F.lit(None).cast("map<string, struct<target: string, stance: string, score: string, lean: string>>").alias("r"))
    rows = scored.unionByName(idle).select("id", "r", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    hit = F.try_element_at(F.coalesce("r", F.create_map().cast("map<string, struct<target: string, stance: string, score: string, lean: string>>")), F.col("target"))
    valid = F.when(hit["stance"].isin("pro", "anti", "neutre"), hit["stance"]).otherwise("non_concerne")
    return rows.select(F.col("id").alias("article_id"), "target", valid.alias("stance"), clamp(hit["score"], 0.0, 1.0).alias("score"), clamp(hit["lean"], -1.0, 1.0).alias("lean"))


def technique_rows(answers: DataFrame, known: list[str], most: int = 3) -> DataFrame:
    """article_id, technique, confiance, extrait: the first known techniques of each reply, within bounds."""
    parsed = F.from_json(lenient_json(F.col("reply")), "techniques array<struct<technique: string, confiance: string, extrait: string>>")
    valid = F.slice(F.filter(F.coalesce(parsed["techniques"], F.array()), lambda t: t["technique"].isin(known)), 1, most)
    return answers.select(F.col("id").alias("article_id"), F.explode(valid).alias("t")).select("article_id", "t.technique", clamp(F.col("t.confiance"), 0.0, 1.0).alias("confiance"), F.left("t.extrait", F.lit(400)).alias("extrait"))


def topic_label(top_words: str = "top_words", most: int = 3):
    """A label from the first keywords, for want of a model's."""
    return F.concat_ws(" / ", F.slice(F.transform(F.split(top_words, ","), lambda w: F.trim(w)), 1, most))


def validation(judged: DataFrame) -> DataFrame:
    """topic_key, coherence, distinction of judgements (topic_key, control, accepted): members accepted, strangers refused."""
    part = lambda ok, of: F.round(F.count_if(ok & of) / F.nullif(F.count_if(of), F.lit(0)).cast("double"), 6)
    member = ~F.col("control")
    return judged.groupBy("topic_key").agg(part(F.col("accepted"), member).alias("coherence"), part(~F.col("accepted"), F.col("control")).alias("distinction"), F.count_if(member).alias("n_test"), F.count_if(F.col("control")).alias("n_controle"))
