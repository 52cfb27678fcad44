"""Quality classifier: hashed word n-grams and word shapes, FTRL logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.linear import Ftrl, counted, judged, score, train
from pressloom.llm.shared import settle
from pressloom.llm.textkit import hashes, mix, ngrams, words

SETTINGS = Ftrl(alpha=0.5)
THRESHOLD = 0.3
_AGAIN = np.uint64(0x5851F42D4C957F2D)
#: Upper-case letters A; lower-case ones and bytes beyond ASCII a; digits 9; white space one blank.
_CLASS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
_SHAPES: dict[bytes, int] = {}


def shapes(text: str) -> list[bytes]:
    """Of each word: its characters by class, runs of a class as one character."""
    c = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_CLASS), np.uint8)
    first = np.ones(len(c), bool)
    first[1:] = c[1:] != c[:-1]
    return c[first].tobytes().split()


def _shape_hash(form: bytes) -> int:
    got = _SHAPES.get(form)
    if got is None:
        if len(_SHAPES) > 100_000:
            _SHAPES.clear()
        got = _SHAPES[form] = int(hashes([form])[0])
    return got


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Uni- and bigrams of words, uni- to trigrams of word shapes (a word like the one before it is marked), each family of length 1."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.int64), np.zeros(0)
    h = hashes(ws)
    form = np.fromiter(map(_shape_hash, shapes(text)), np.uint64, len(ws))
    same = np.zeros(len(ws), bool)
    same[1:] = h[1:] == h[:-1]
    form[same] = _AGAIN
    places, values = [], []
    for seed, scale, parts in ((1, 0.5, [h, ngrams(h, 2)]), (2, 2.0, [form, ngrams(form, 2), ngrams(form, 3)])):
        i, c = counted(mix(np.concatenate([p + np.uint64(seed * 1000 + k) for k, p in enumerate(parts)])), bits)
        x = np.sqrt(c)
        places.append(i)
        values.append(scale * x / np.sqrt(x @ x))
    return np.concatenate(places), np.concatenate(values)


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Ftrl = SETTINGS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, learned from labels.quality outside fold 0.

    Null or empty text: the score of the bias. No labels: every score is 0.5.
    Rows that repeat a doc_id each get their own score. Other columns are ignored.
    """
    weights = train(docs, labels, "quality", features, settings)
    return judged(score(docs, weights, features, settings.bits), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, settings: Ftrl = SETTINGS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with their columns. A doc_id goes if all of its rows are rejected."""
    bad = quality_scores(docs, labels, settings, threshold).groupBy("doc_id").agg(F.max("predicted").alias("p")).filter("p = 0 AND doc_id IS NOT NULL").select("doc_id")
    return docs.join(settle(bad, "rejected"), "doc_id", "left_anti").select(docs.columns)
