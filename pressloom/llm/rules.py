"""Quality rules: a ledger of failure bits and measurements, versioned policies, ablations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.shared import settle, texts
from pressloom.llm.textkit import mix

#: Name and condition of failure, over the measurements. A rule's bit is its place here; new rules go to the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 8 * word_chars"),
    ("shouting", "100 * n_upper > 60 * word_chars"),
    ("repeated_lines", "n_dup_lines > 3 AND 100 * n_dup_lines > 60 * n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long"


@dataclass(frozen=True)
class Policy:
    """A version: a document passes if it fails none of these rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
WEB = Policy("web-1", tuple(name for name, _ in RULES))
POLICIES = {p.version: p for p in (BASE, WEB)}

_BLANK = " \t\n\x0b\x0c\r"


def measure(text: str) -> tuple[int, ...]:
    data = text.encode("utf-8", "surrogatepass")
    ws = data.split()
    n = len(ws)
    blanks = sum(map(text.count, _BLANK))
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    repeated = 0
    if n >= 3:
        h = np.fromiter(map(hash, ws), np.int64, n).view(np.uint64)  # only compared within this text
        windows = mix(mix(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])
        _, at, count = np.unique(windows, return_inverse=True, return_counts=True)
        again = count[at] > 1
        hit = np.zeros(n, bool)
        for i in range(3):
            hit[i : n - 2 + i] |= again
        repeated = int(hit.sum())
    letters = np.frombuffer(data, np.uint8)
    return n, len(text) - blanks, sum(map(text.count, "#*$%&|<>")), len(lines), len(lines) - len(set(lines)), repeated, int(((letters >= 65) & (letters <= 90)).sum())


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in MEASURES.split(",")]
    for pdf in batches:
        rows = np.array([measure(t) for t in pdf["text"]], np.int64).reshape(len(pdf), len(names))
        yield pd.DataFrame(rows, columns=names).assign(doc_id=pdf["doc_id"].to_numpy())


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, failed (long: a bit for each rule that the row's text fails), for every row of docs.

    Each rule is evaluated once; policies and ablations read only the bits.
    Null text counts as empty (0 words). Repeated rows and null ids each keep
    their row. Other columns are ignored.
    """
    made = texts(docs).mapInPandas(_measured, f"doc_id long, {MEASURES}")
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return made.withColumn("failed", failed)


def passes(policy: Policy, failed: Column | None = None) -> Column:
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(policy.mask)) == 0


def ablations(entries: DataFrame, policies: list[Policy]) -> DataFrame:
    """version, rule, failing, kept, kept_without: what each policy keeps, and would keep without each of its rules.

    The ledger is first counted by its bits (2**rules rows at most); every
    ablation is a masked sum over those counts.
    """
    counts = entries.groupBy("failed").agg(F.count("*").alias("n"))
    cases = [(p.version, r, p.mask, BIT[r]) for p in policies for r in p.rules]
    each = counts.withColumn("case", F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for v, r, m, b in cases]))).select("failed", "n", "case.*")
    total = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0))
    bit, mask = F.col("failed").bitwiseAND(F.col("bit")), F.col("failed").bitwiseAND(F.col("mask"))
    without = F.col("failed").bitwiseAND(F.col("mask").bitwiseAND(F.bitwise_not(F.col("bit"))))
    return each.groupBy("version", "rule").agg(total(bit != 0).alias("failing"), total(mask == 0).alias("kept"), total(without == 0).alias("kept_without"))


def keep_passing(docs: DataFrame, policy: Policy = WEB) -> DataFrame:
    """The rows of docs whose doc_id has a row that passes, with their columns; rows with a null doc_id stay."""
    entries = ledger(docs).filter("doc_id IS NOT NULL").select("doc_id", passes(policy).alias("ok"))
    gone = entries.groupBy("doc_id").agg(F.max("ok").alias("ok")).filter("NOT ok").select("doc_id")
    return docs.join(settle(gone, "failed"), "doc_id", "left_anti").select(docs.columns)
