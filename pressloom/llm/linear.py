"""Logistic regression over hashed word n-grams: FTRL-proximal training, sparse scoring."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.shared import fold, settle, texts

#: A text as features: hashed places (below 2**bits) and values, places distinct.
Features = Callable[[str, int], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Ftrl:
    """Settings. max_rows bounds the labelled sample that is learned from, at every input size."""

    bits: int = 18
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0
    epochs: int = 3
    positive_weight: float = 1.0
    max_rows: int = 24_000


def counted(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed places and how often each occurs."""
    return np.unique((h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)


class State:
    """z and n of each coordinate, the last one being the unpenalised bias. Each coordinate has its own rate, by the squared gradients it has seen."""

    def __init__(self, s: Ftrl, data: bytes | None = None) -> None:
        self.s, size = s, (1 << s.bits) + 1
        self.z, self.n = np.frombuffer(data).reshape(2, size).copy() if data else np.zeros((2, size))
        self.l1 = np.full(size, s.l1)
        self.l1[-1] = 0

    def data(self) -> bytes:
        return np.stack([self.z, self.n]).tobytes()

    def weights(self, i) -> np.ndarray:
        s, z, l1 = self.s, self.z[i], self.l1[i]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(self.n[i])) / s.alpha + s.l2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        """One step on a text: distinct places, values, label."""
        s = self.s
        i, x = np.append(i, len(self.z) - 1), np.append(x, 1.0)
        w, n = self.weights(i), self.n[i]
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x * (s.positive_weight if y else 1.0)
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / s.alpha * w
        self.n[i] += g * g


def train(docs: DataFrame, labels: DataFrame, label: str, features: Features, s: Ftrl, folds: int = 5) -> np.ndarray:
    """Weights learned from at most about max_rows labelled rows outside fold 0.

    The sample is by a hash of doc_id, and so is its order. Its features are made
    where the texts are, and written; then one task streams them in each epoch,
    a few at a time, and hands z and n to the next one. So no task holds the
    sample, however long its texts, and no step is averaged away. The result has
    2**bits + 1 numbers, whatever the input. Null labels teach nothing; of labels
    repeated for a doc_id the largest holds.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y")).filter(fold(F.col("doc_id"), folds) != 0)
    known = settle(known, "labels")
    share = min(1.0, s.max_rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003))
    sample = known.filter(draw < int(share * 1_000_003))
    # max_rows bounds the sample, so it may be broadcast
    rows = texts(docs).join(F.broadcast(sample), "doc_id")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in (pdf.iloc[k : k + 50] for k in range(0, len(pdf), 50)):
                each = [features(t, s.bits) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "y": part["y"].to_numpy(), "at": [i.astype("<i4").tobytes() for i, _ in each], "x": [np.asarray(x, "<f4").tobytes() for _, x in each]})

    table = settle(rows.mapInPandas(made, "doc_id long, y int, at binary, x binary"), "features")
    state = State(s)
    for epoch in range(s.epochs):
        before = zlib.compress(state.data(), 1)

        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now = State(s, zlib.decompress(before))
            for pdf in batches:
                for at, x, y in zip(pdf["at"], pdf["x"], pdf["y"], strict=True):
                    now.learn(np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float), int(y))
            yield pd.DataFrame({"state": [zlib.compress(now.data(), 1)]})

        # one task by design: steps follow each other, over a sample of bounded size
        order = [F.xxhash64("doc_id", F.lit(31 + epoch)), "doc_id", F.xxhash64("at", "x")]
        after = table.repartition(1).sortWithinPartitions(*order).mapInPandas(learn, "state binary").collect()  # a row of 2**(bits + 4) bytes at most
        state = State(s, zlib.decompress(after[0]["state"])) if after else state
    return state.weights(np.arange((1 << s.bits) + 1))


def score(docs: DataFrame, weights: np.ndarray, features: Features, bits: int) -> DataFrame:
    """doc_id, score: the probability of label 1 for every row of docs. An empty text gets the bias alone."""
    at = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((at, weights[at].astype(np.float32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = np.zeros((1 << bits) + 1, np.float32)
        w[shared.value[0]] = shared.value[1]
        for pdf in batches:
            sums = np.array([float(w[i] @ x) for i, x in (features(t, bits) for t in pdf["text"])]) + float(w[-1])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": 1 / (1 + np.exp(-np.clip(sums, -30, 30)))})

    return texts(docs).mapInPandas(run, "doc_id long, score double")


def judged(scores: DataFrame, threshold: float, folds: int = 5) -> DataFrame:
    return scores.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
