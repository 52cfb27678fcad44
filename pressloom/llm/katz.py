"""Katz backoff bigram model: Good-Turing discounts, exactly normalised backoff weights, a score for every text."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.shared import fold, new_path, settle, texts
from pressloom.llm.textkit import hashes, mix, words

#: Counts up to K are discounted by Good-Turing; larger ones lose EASE, so that every context keeps mass for what it hasn't seen.
K, EASE = 5, 0.1
#: Tokens of a batch that is sent at a time, and of a bucket of words, about; occurrences of a word or bigram from which its own are dealt to several groups.
BATCH_TOKENS, BUCKET_TOKENS, HOT_TOKENS = 2_000_000, 2_000_000, 1_500_000
END, START = (int(hashes([b" " + name])[0]) for name in (b"end", b"start"))
_48 = np.uint64((1 << 48) - 1)
#: What a text's score is made of, summed by word bucket (see _reduce).
_SUMS = ["base", "large", "plain", "context"]
_NUMBERS = ["n", "known", *[f"s{r}" for r in range(1, K + 1)], "plains", *[f"u{r}" for r in range(K + 1)]]
_STATS = [*_SUMS, *_NUMBERS]
#: What a context's backoff weight is made of: followers with large counts (their sum, number), by small count, and the same of the followers' own counts.
_SIDES = ["t0", "n0", *[f"q{r}" for r in range(1, K + 1)], "w0", "m0", *[f"p{r}" for r in range(1, K + 1)]]
_ROWS = "kind int, key long, blob binary, v long, n long"
_DOCS, _IDS, _CONTEXTS, _COUNTS, _UNSEEN = range(5)


def _squeeze(*arrays: np.ndarray) -> bytes:
    parts = [zlib.compress(np.ascontiguousarray(a).tobytes(), 1) for a in arrays]
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _spread(blob: bytes, *types: str) -> list[np.ndarray]:
    sizes, at, out = struct.unpack_from(f"<{len(types)}I", blob), 4 * len(types), []
    for size, kind in zip(sizes, types, strict=True):
        out.append(np.frombuffer(zlib.decompress(blob[at : at + size]), kind))
        at += size
    return out


def _high(h: np.ndarray, parts: int) -> np.ndarray:
    """A bucket that rises with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _among(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x stands in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


@dataclass(frozen=True)
class _Hot:
    """A word, or a bigram of it, that is too frequent for one group: its counts in training, known beforehand, and the groups that its occurrences are dealt to."""

    first: int
    parts: int
    word: int
    before: int | None
    count: int
    pair: int


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list, list]]:
    """Ids, whether they train, and hashes of tokens of documents, a batch at a time."""
    ids, train, hs, size = [], [], [], 0
    for pdf in frames:
        for d, t, text in zip(pdf["doc_id"], pdf["train"], pdf["text"], strict=True):
            ids.append(None if pd.isna(d) else int(d))
            train.append(bool(t))
            hs.append(np.append(hashes(words(text, lower=True)), np.uint64(END)))
            size += len(hs[-1])
            if size >= BATCH_TOKENS or len(ids) == 1 << 16:
                yield ids, train, hs
                ids, train, hs, size = [], [], [], 0
    if ids:
        yield ids, train, hs


def _bigrams(hs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each occurrence's word, 48 bits of the word before, and number of its document."""
    n = np.array([len(h) for h in hs])
    w = np.concatenate(hs)
    v = np.concatenate([[np.uint64(0)], w[:-1]])
    v[np.cumsum(n) - n] = np.uint64(START)
    return w, v & _48, np.repeat(np.arange(len(hs)), n).astype(np.uint16)


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch's words, how often they occur and how often in training; under START how many tokens there are."""
    for _, train, hs in _batches(frames):
        word, w = np.unique(np.concatenate(hs), return_inverse=True)
        n = np.bincount(w)
        t = np.bincount(w, np.repeat(train, [len(h) for h in hs])).astype(np.int64)
        yield pd.DataFrame({"w": np.append(word, np.uint64(START)).astype(np.int64), "n": np.append(n, n.sum()), "t": np.append(t, t.sum())})


def _pair_counts(hot: np.ndarray):
    """Each batch's bigrams of two hot words, or of one that begins a text, counted as words are."""
    befores = np.unique(np.append(hot, np.uint64(START)) & _48)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, train, hs in _batches(frames):
            w, v, doc = _bigrams(hs)
            w, hit = _among(hot, w)
            v, both = _among(befores, v)
            hit &= both
            pair, number = np.unique(w[hit] * len(befores) + v[hit], return_inverse=True)
            n = np.bincount(number, minlength=len(pair))
            t = np.bincount(number, np.array(train)[doc[hit]], minlength=len(pair)).astype(np.int64)
            yield pd.DataFrame({"w": hot[pair // len(befores)].astype(np.int64), "v": befores[pair % len(befores)].astype(np.int64), "n": n, "t": t})

    return run


def _hot(rows: DataFrame, most: int, buckets: int | None) -> tuple[list[_Hot], int]:
    """Words and bigrams with more than `most` occurrences, in the order of their groups, and the number of buckets for the other words.

    There are at most tokens / most of either. Their occurrences are dealt to
    groups of about `most`: a word's by the word before, a bigram's by batch.
    """
    total = [F.sum("n").alias("n"), F.sum("t").alias("t")]
    found = rows.mapInPandas(_word_counts, "w long, n long, t long").groupBy("w").agg(*total)
    found = {r["w"] % (1 << 64): (r["n"], r["t"]) for r in found.filter((F.col("n") > most) | (F.col("w") == int(np.uint64(START).astype(np.int64)))).collect()}
    tokens, _ = found.pop(START, (0, 0))
    if buckets is None:
        buckets = max(8, math.ceil((tokens - sum(n for n, _ in found.values())) / BUCKET_TOKENS))
    pairs = {w: [] for w in sorted(found)}
    if found:
        twice = rows.mapInPandas(_pair_counts(np.array(list(pairs), np.uint64)), "w long, v long, n long, t long")
        for r in twice.groupBy("w", "v").agg(*total).filter(F.col("n") > most).collect():
            pairs[r["w"] % (1 << 64)].append((r["v"], r["n"], r["t"]))
    out, at = [], buckets
    for w, its in pairs.items():
        n, t = found[w]
        for v, m, p in [(None, n - sum(m for _, m, _ in its), 0), *sorted(its)]:
            out.append(_Hot(at, max(1, math.ceil(m / most)), w, v, t, p))
            at += out[-1].parts
    return out, buckets


def _occurrences(buckets: int, hot: list[_Hot]):
    """Bigram occurrences of batches of documents, dealt by a hash of the second word, those of hot ones further: packed, a row for each batch and group.

    A row holds its distinct words and how often each occurs, then for each
    occurrence 48 bits of the hash of the word before and the document's number
    in the batch. Another row for each batch names its documents.
    """
    alone = [h for h in hot if h.before is None]
    pairs = {h.word: [p for p in hot if p.word == h.word and p.before is not None] for h in alone}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for number, (ids, train, hs) in enumerate(_batches(frames)):
            batch = part * (1 << 20) + number
            w, v, doc = _bigrams(hs)
            order = np.argsort(w, kind="stable")
            w, v, doc = w[order], v[order], doc[order]
            flags = np.packbits(np.array(train, bool))
            out, rest = [], np.ones(len(w), bool)

            def pack(group, w, v, doc):
                word, first = np.unique(w, return_index=True)
                count = np.diff(np.append(first, len(w))).astype(np.uint32)
                before = np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8)[:, :6]
                out.append((group, batch, _squeeze(word, count, doc, flags) + before.tobytes()))

            for h in alone:
                i, j = np.searchsorted(w, np.uint64(h.word)), np.searchsorted(w, np.uint64(h.word), "right")
                if i == j:
                    continue
                rest[i:j] = False
                group = h.first + _high(mix(v[i:j]), h.parts)
                its = pairs[h.word]
                at, hit = _among(np.array([p.before for p in its], np.uint64), v[i:j])
                turn = int(mix(np.array([batch], np.uint64))[0])
                group[hit] = np.array([p.first + turn % p.parts for p in its], np.int64)[at[hit]]
                by = np.argsort(group, kind="stable")
                for some in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
                    pack(int(group[some[0]]), w[i + some], v[i + some], doc[i + some])
            if not rest.all():
                w, v, doc = w[rest], v[rest], doc[rest]
            ends = np.searchsorted(_high(w, buckets), np.arange(buckets + 1))
            for b, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if i < j:
                    pack(b, w[i:j], v[i:j], doc[i:j])
            known = np.array([d if d is not None else 0 for d in ids], np.int64)
            out.append((-1 - batch % buckets, batch, _squeeze(known, np.array([d is None for d in ids]), np.array(train, bool))))
            yield pd.DataFrame(out, columns=["bucket", "batch", "blob"])

    return run


def _class(count: np.ndarray, keep: np.ndarray, owner: np.ndarray, n: int, low: int) -> list[np.ndarray]:
    """How many of each owner's kept rows have count low, ..., K."""
    return [np.bincount(owner[keep & (count == r)], minlength=n) for r in range(low, K + 1)]


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key stands first, and each key's number among them. keys is used up."""
    order = np.argsort(keys)
    keys = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return order[fresh], number


def _context_rows(before: np.ndarray, r: np.ndarray, c: np.ndarray, contexts: int) -> list[tuple]:
    """What distinct bigrams in training (the word before, their count, the second word's) say of their contexts, by bucket of context."""
    context, x = np.unique(before, return_inverse=True)
    m, here = len(context), np.ones(len(r), bool)
    sides = [np.bincount(x, r * (r > K), minlength=m), np.bincount(x, r > K, minlength=m), *_class(r, here, x, m, 1), np.bincount(x, c * (c > K), minlength=m), np.bincount(x, c > K, minlength=m), *_class(c, here, x, m, 1)]
    table = np.stack(sides).astype("<i8")
    ends = np.searchsorted(_high(context << np.uint64(16), contexts), np.arange(contexts + 1))
    return [(_CONTEXTS, k, _squeeze(context[i:j], table[:, i:j]), 0, 0) for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if i < j]


def _pair_numbers(cp: np.ndarray) -> list[tuple]:
    return [(_COUNTS, r, None, 0, int((cp == r).sum())) for r in range(1, K + 2)]


def _word_numbers(cw: np.ndarray) -> list[tuple]:
    return [(_COUNTS, 10 + r, None, 0, int((cw == r).sum())) for r in range(1, K + 2)] + [(_COUNTS, 20, None, 0, int(cw.sum())), (_COUNTS, 21, None, 0, int((cw > 0).sum()))]


def _hot_rows(hot: list[_Hot], contexts: int) -> list[tuple]:
    """The rows of contexts and counts that no group gives, since hot words and bigrams are in several."""
    pairs = [h for h in hot if h.before is not None and h.pair]
    cw, cp = np.array([h.count for h in hot if h.before is None], np.int64), np.array([h.pair for h in pairs], np.int64)
    before = np.array([h.before for h in pairs], np.uint64)
    return [*(_context_rows(before, cp, np.array([h.count for h in pairs], np.int64), contexts) if pairs else []), *_pair_numbers(cp), *_word_numbers(cw)]


def _reduce(contexts: int, hot: list[_Hot]):
    """Counts of one bucket of words, and what they say of documents and contexts.

    All occurrences of a word are here, so its count and its bigrams' counts are;
    the counts of a hot word or bigram, of which a group holds a part, are known.
    Discounts aren't known yet: they need every bucket's counts of counts. So for
    each document the bucket gives sums and numbers by small count, from which
    the score follows once discounts are known; and for each context likewise
    what its backoff weight is made of. Bigrams that training lacks (only held-out
    documents have them) are listed with their context.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] < 0:
            trained = sum(int(_spread(b, "<i8", "?", "?")[2].sum()) for b in pdf["blob"])
            return pd.DataFrame([(_IDS, r.batch, r.blob, 0, 0) for r in pdf.itertuples()] + [(_COUNTS, 22, None, 0, trained)], columns=["kind", "key", "blob", "v", "n"])
        w_parts, n_parts, d_parts, v_parts, t_parts = [], [], [], [], []
        batches = pdf["batch"].to_numpy(np.int64)
        for k, blob in enumerate(pdf["blob"]):
            word, count, doc, flags = _spread(blob, "<u8", "<u4", "<u2", "u1")
            before = np.zeros((len(doc), 8), np.uint8)
            before[:, :6] = np.frombuffer(blob, np.uint8)[len(blob) - 6 * len(doc) :].reshape(-1, 6)
            w_parts.append(word)
            n_parts.append(count)
            v_parts.append(before.view("<u8").ravel())
            d_parts.append(k * (1 << 16) + doc.astype(np.int32))
            t_parts.append(np.unpackbits(flags).astype(bool)[doc])
        word, run_of = np.unique(np.concatenate(w_parts), return_inverse=True)
        w = np.repeat(run_of.astype(np.int32), np.concatenate(n_parts))
        v, doc, train = np.concatenate(v_parts), np.concatenate(d_parts), np.concatenate(t_parts)
        del w_parts, n_parts, v_parts, d_parts, t_parts
        its = next((h for h in reversed(hot) if h.first <= pdf["bucket"].iloc[0]), None)
        cw = np.bincount(w[train], minlength=len(word)) if its is None else np.array([its.count], np.int64)
        first, pair = _numbered(mix(v * np.uint64(0x9E3779B97F4A7C15) + mix(w.astype(np.uint64))))
        cp = np.bincount(pair[train], minlength=len(first)) if its is None or its.before is None else np.array([its.pair], np.int64)
        rows = []

        # documents
        docs, d = np.unique(doc, return_inverse=True)
        n, d = len(docs), d.astype(np.int32)
        kind = np.int32 if its is None else np.int64
        c, r = cw[w].astype(kind), cp[pair].astype(kind)
        del pair
        seen = r > 0
        log = lambda x: np.log10(np.maximum(x, 1e-9))
        word_log = [log(cw + 0.1), log(cw - EASE), np.where(word == np.uint64(END), 0.0, log(np.maximum(cw, 1)))]
        total = lambda x, keep: np.bincount(d[keep], x, minlength=n)
        large, plain = r > K, ~seen & (c > K)
        sums = np.stack([np.bincount(d, word_log[0][w], minlength=n), total(log(r[large] - EASE), large), total(word_log[1][w[plain]], plain), np.bincount(d, word_log[2][w], minlength=n)])
        numbers = np.stack([np.bincount(d, minlength=n), np.bincount(d[c > 0], minlength=n), *_class(r, seen, d, n, 1), np.bincount(d[plain], minlength=n), *_class(c, ~seen, d, n, 0)])
        ends = np.searchsorted(docs, np.arange(len(batches) + 1) * (1 << 16))
        rows += [(_DOCS, batches[k], _squeeze((docs[i:j] % (1 << 16)).astype(np.uint16), sums[:, i:j].astype("<f8"), numbers[:, i:j].astype("<i4")), 0, 0) for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if i < j]
        if not seen.all():
            miss = ~seen
            refs = batches[doc[miss] >> 16] * (1 << 16) + (doc[miss].astype(np.int64) & 0xFFFF)
            pairs, times = np.unique(np.stack([refs, v[miss].astype(np.int64)]), axis=1, return_counts=True)
            rows += [(_UNSEEN, a, None, b, t) for a, b, t in zip(*pairs.tolist(), times.tolist(), strict=True)]

        # contexts, counts of counts
        if its is None or its.before is None:
            kept = np.flatnonzero(cp)
            rows += _context_rows(v[first[kept]], cp[kept], cw[w[first[kept]]], contexts) + _pair_numbers(cp)
        if its is None:
            rows += _word_numbers(cw)
        return pd.DataFrame(rows, columns=["kind", "key", "blob", "v", "n"])

    return run


def discounts(n: list[int]) -> list[float]:
    """Good-Turing mass of counts 1 to K (times the count), from the numbers of things seen 1 to K + 1 times.

    Where these numbers give no discount between 0 and 1, as with little data,
    half a count is taken off instead.
    """
    out = []
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        ratio = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0
        d = (ratio - common) / (1 - common) if common < 1 else 0.0
        out.append(d * r if 0 < d < 1 else r - 0.5)
    return out


@dataclass(frozen=True)
class Model:
    """What is known of the whole training text: its tokens, distinct tokens and documents; discounted mass by small count of bigrams and of words."""

    tokens: int
    distinct: int
    documents: int
    pair: tuple[float, ...]
    word: tuple[float, ...]
    unknown: float

    def context_correction(self, sides: np.ndarray) -> np.ndarray:
        """log10 of count times backoff weight of contexts, columns as in _SIDES."""
        s = dict(zip(_SIDES, sides.astype(float), strict=True))
        count = s["t0"] + sum(r * s[f"q{r}"] for r in range(1, K + 1))
        mass = s["t0"] - EASE * s["n0"] + sum(self.pair[r - 1] * s[f"q{r}"] for r in range(1, K + 1))
        lower = (s["w0"] - EASE * s["m0"] + sum(self.word[r - 1] * s[f"p{r}"] for r in range(1, K + 1))) / self.tokens
        return np.log10((count - mass) / (1 - lower))

    def score(self, stats: np.ndarray) -> np.ndarray:
        """log10 probability of texts, columns as in _STATS, but for the correction of bigrams that training lacks."""
        s = dict(zip(_STATS, stats, strict=True))
        if not self.tokens:
            return np.zeros(stats.shape[1])
        out = s["large"] + sum(s[f"s{r}"] * math.log10(self.pair[r - 1]) for r in range(1, K + 1))
        out += s["plain"] + sum(s[f"u{r}"] * math.log10(self.word[r - 1]) for r in range(1, K + 1))
        out -= (s["plains"] + sum(s[f"u{r}"] for r in range(1, K + 1))) * math.log10(self.tokens)
        out += s["u0"] * math.log10(self.unknown)
        return out - s["context"] - math.log10(self.documents)


def katz_scores(docs: DataFrame, folds: int = 10, buckets: int | None = None, most: int = HOT_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Learns from the rows outside fold 0. Tokens are lower-case words and one end.
    A word's probability after another is the discounted share of the bigram, or
    the first word's backoff weight times the discounted share of the word alone;
    words that training lacks share one place. Over all words each context's
    probabilities sum to 1. base_score is the add-0.1 unigram score.

    Occurrences cross the network once, packed, by bucket of the word; then
    sums by document and by context do. Words and bigrams with more than `most`
    occurrences are counted before and dealt to several groups, so that no group
    grows with the share of a word. Words are told apart by 64 bits of a
    hash, contexts of one word by 48. Null or empty text: the end alone. Repeated
    rows each get their score, null ids count as held out. Without training rows
    every score is 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = texts(docs).withColumn("train", fold(F.col("doc_id"), folds) != 0)
    hot, buckets = _hot(rows, most, buckets)
    packed = rows.mapInPandas(_occurrences(buckets, hot), "bucket int, batch long, blob binary")
    path = new_path(spark, "katz")
    packed.groupBy("bucket").applyInPandas(_reduce(buckets, hot), _ROWS).write.partitionBy("kind").parquet(path)
    if hot:
        spark.createDataFrame(_hot_rows(hot, buckets), _ROWS).coalesce(1).write.mode("append").partitionBy("kind").parquet(path)
    table = spark.read.schema(_ROWS).parquet(path)

    counts = {r["key"]: r["n"] for r in table.filter(F.col("kind") == _COUNTS).groupBy("key").agg(F.sum("n").alias("n")).collect()}  # 15 rows
    get = lambda k: counts.get(k, 0)
    tokens, word = get(20), discounts([get(10 + r) for r in range(1, K + 2)])
    large = get(21) - sum(get(10 + r) for r in range(1, K + 1))
    unknown = (sum((r - word[r - 1]) * get(10 + r) for r in range(1, K + 1)) + EASE * large) / tokens if tokens else 1.0
    model = Model(tokens, get(21), max(1, get(22)), tuple(discounts([get(r) for r in range(1, K + 2)])), tuple(word), unknown)

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_spread(b, "<u8", "<i8") for b in pdf["blob"]]
        context, x = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        sides = np.concatenate([s.reshape(len(_SIDES), -1) for _, s in parts], axis=1)
        sums = np.stack([np.bincount(x, s, minlength=len(context)) for s in sides])
        return pd.DataFrame({"v": context.astype(np.int64), "correction": model.context_correction(sums)})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, nulls, train = _spread(next(b for b, k in zip(pdf["blob"], pdf["kind"], strict=True) if k == _IDS), "<i8", "?", "?")
        sums = np.zeros((len(_STATS), len(ids)))
        for blob, kind in zip(pdf["blob"], pdf["kind"], strict=True):
            if kind == _DOCS:
                doc, parts, numbers = _spread(blob, "<u2", "<f8", "<i4")
                sums[: len(_SUMS), doc] += parts.reshape(len(_SUMS), -1)
                sums[len(_SUMS) :, doc] += numbers.reshape(len(_NUMBERS), -1)
        n, known = (sums[_STATS.index(k)] for k in ("n", "known"))
        base = sums[0] - n * math.log10(model.tokens + 0.1 * (model.distinct + 1))
        key = int(pdf["key"].iloc[0]) * (1 << 16) + np.arange(len(ids))
        return pd.DataFrame({"ref": key, "doc_id": pd.array(ids, "Int64").copy() if not nulls.any() else pd.array([None if z else int(i) for i, z in zip(ids, nulls, strict=True)], "Int64"), "held_out": ~train, "n_tokens": n.astype(np.int64), "n_known": known.astype(np.int64), "base_score": base, "plain": model.score(sums)})

    backoff = table.filter(F.col("kind") == _CONTEXTS).select("key", "blob").groupBy("key").applyInPandas(weigh, "v long, correction double")
    backoff = settle(backoff, "backoff")
    unseen = table.filter(F.col("kind") == _UNSEEN).select(F.col("key").alias("ref"), "v", "n")
    more = unseen.join(backoff, "v").groupBy("ref").agg(F.sum(F.col("n") * F.col("correction")).alias("more"))
    scored = table.filter(F.col("kind").isin(_DOCS, _IDS)).select("kind", "key", "blob").groupBy("key").applyInPandas(total, "ref long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, plain double")
    out = scored.join(more, "ref", "left")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", (F.col("plain") + F.coalesce("more", F.lit(0.0))).alias("score"))
