"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pressloom.llm.linear import Ftrl, counted, judged, score, train
from pressloom.llm.textkit import hashes, mix, ngrams, words

SETTINGS = Ftrl(alpha=3.0, l1=10.0, l2=0.1, epochs=4, positive_weight=2.0)
THRESHOLD = 0.5
_STRIP = b".,;:!?\"'()[]{}*#$%&|<>"


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case words without punctuation around them: presence of unigrams, bigrams, and pairs with one word between."""
    ws = [w for w in (x.strip(_STRIP) for x in words(text, lower=True)) if w]
    if not ws:
        return np.zeros(0, np.int64), np.zeros(0)
    h = hashes(ws)
    skips = mix(h[:-2] * np.uint64(7) + h[2:]) if len(h) > 2 else h[:0]
    i, _ = counted(mix(np.concatenate([h, ngrams(h, 2) + np.uint64(1), skips + np.uint64(2)])), bits)
    return i, np.ones(len(i))


def toxicity_scores(docs: DataFrame, labels: DataFrame, settings: Ftrl = SETTINGS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, learned from labels.toxic outside fold 0.

    L1 leaves few weights other than 0, which are broadcast as places and
    values. Null or empty text: the score of the bias. No labels: every score is
    0.5. Rows that repeat a doc_id each get their own score. Other columns are
    ignored.
    """
    weights = train(docs, labels, "toxic", features, settings)
    return judged(score(docs, weights, features, settings.bits), threshold)
