"""Exact token counts at every prefix of a text, by dynamic programming over its bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm.shared import small_batches
from pressloom.llm.textkit import BLANKS, Encoder

#: Words of unaccented or, as group 1, accented letters, which the vocabularies' pattern never splits.
_WORD = re.compile("[ \n]?(?:[A-Za-z]+|([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+))")
#: What is known of so many first bytes is kept for other words.
HEAD = 6
#: Code points whose counts leave a task in one Arrow batch.
BATCH_CHARS = 2_000_000


class PrefixCounter:
    """Tokens of every prefix of texts under a byte-level BPE vocabulary.

    The tokens of a prefix are those of the prefix without its last token, and
    that token. So the last token at each byte is the one that may follow the
    last token of where it starts: two tokens may follow each other if their
    joined bytes encode to just these two, and of all entries that end at a byte
    only one may. A cut inside a word doesn't
    change how the text before is split, with three exceptions: white space at
    the end stays together, half a contraction isn't one, and half a special
    token's string is plain text.

    Counts of distinct chunks (white space and the word after it) are kept, and
    emptied beyond `most` chunks; so are the pairs that were looked up.
    """

    def __init__(self, path: str, most: int = 600_000):
        self.encoder, self.most = Encoder(path), most
        tokenizer = self.encoder.tokenizer
        self.split, self.model = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model
        self.vocab = tokenizer.get_vocab(with_added_tokens=False)
        #: How the vocabulary writes the characters of _WORD.
        self.letters = {c: self.split(c)[0][0] for c in map(chr, [0x20, *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)])}
        self.tails = {t[i:] for t in self.vocab for i in range(len(t))}
        #: Strings that the tokenizer takes for one token wherever they stand.
        self.specials = sorted((a.content for a in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, np.ndarray] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.heads: dict[str, tuple[list, list, list]] = {}

    def _follows(self, before: str | None, token: str) -> bool:
        if (before, token) not in self.pairs:
            want = [token] if before is None else [before, token]
            self.pairs[before, token] = [t.value for t in self.model.tokenize("".join(want))] == want
        return self.pairs[before, token]

    def _run(self, piece: str) -> list[int]:
        """Tokens of every prefix of a piece, whose bytes are written as the vocabulary's characters."""
        vocab, tails, pairs = self.vocab, self.tails, self.pairs
        head = piece[:HEAD]
        begun = self.heads.get(head) if len(piece) > HEAD else None
        last, count, starts = ([*x] for x in begun or ([None], [0], [0]))
        for end in range(len(last), len(piece) + 1):
            # only one token can be right, so the likely ones go first: the last one grown by this byte, then the byte alone
            start = starts[-1]
            token = piece[start:end]
            if not (token in vocab and (pairs.get((last[start], token)) or self._follows(last[start], token))):
                start, token = end - 1, piece[end - 1]
                if not (pairs.get((last[start], token)) or self._follows(last[start], token)):
                    fits, start = [], end - 2
                    while start >= 0 and (tail := piece[start:end]) in tails:
                        if tail in vocab:
                            fits.append(start)
                        start -= 1
                    start = next(x for x in reversed(fits) if self._follows(last[x], piece[x:end]))
                    token = piece[start:end]
            last.append(token)
            starts.append(start)
            count.append(count[start] + 1)
            if end == HEAD:
                self.heads[head] = [*last], [*count], [*starts]
        return count

    def _chunk(self, chunk: str) -> np.ndarray:
        """Tokens of chunk[:1], chunk[:2], ..., chunk."""
        if word := _WORD.fullmatch(chunk):
            first = 1 if chunk[0] == "\n" else 0
            piece = chunk[first:]
            run = np.array(self._run("".join(map(self.letters.__getitem__, piece))), np.int32)
            run = run[1:] if word[1] is None else run[np.cumsum([len(c.encode()) for c in piece])]
            return np.append(np.int32(1), run + 1) if first else run
        out = np.zeros(len(chunk), np.int32)
        blank = len(chunk) - len(chunk.lstrip(BLANKS))
        before = 0
        for piece, (start, stop) in self.split(chunk):
            run = self._run(piece)
            if len(piece) == stop - start:
                out[start:stop] = run[1:]
            else:
                out[start:stop] = np.array(run)[np.cumsum([len(c.encode()) for c in chunk[start:stop]])]
            if stop - start == 3 and piece in ("'re", "'ve", "'ll"):
                out[start + 1] = 2
            out[start:stop] += before
            before += run[-1]
        for piece, (start, stop) in self.split(chunk[:blank]) if blank > 1 else ():  # one piece, as it ends the prefix
            out[start:stop] = np.array(self._run(piece))[np.cumsum([len(c.encode()) for c in chunk[start:stop]])]
        return out

    def _plain(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text without special tokens, the empty one first."""
        known, parts = self.known, [np.zeros(1, np.int32)]
        for chunk in filter(None, self.encoder.chunks(text)):
            counts = known.get(chunk)
            if counts is None:
                counts = self._chunk(chunk)
                if len(chunk) <= 200:
                    known[chunk] = counts
            parts.append(counts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        counts = np.concatenate(parts)
        totals = counts[np.cumsum(sizes) - 1]
        return counts + np.repeat(np.cumsum(totals) - totals, sizes).astype(np.int32)

    def __call__(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..., text."""
        if len(self.known) > self.most or len(self.pairs) > self.most:
            self._empty()
        out, base = [np.zeros(1, np.int32)], 0
        while True:
            found = min(((at, s) for s in self.specials if (at := text.find(s)) >= 0), key=lambda x: (x[0], -len(x[1])), default=None)
            if found is None:
                return np.concatenate([*out, self._plain(text)[1:] + base])
            stop = found[0] + len(found[1])
            counts = self._plain(text[:stop])
            counts[-1] = counts[found[0]] + 1
            out.append(counts[1:] + base)
            base += int(counts[-1])
            text = text[stop:]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter a worker process and vocabulary file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _counted(vocabulary: str):
    def batch(rows: list, counts: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, counts)]).astype(np.int32)
        table = pa.Table.from_batches(rows).drop_columns([names[-1]]).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*table.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(counts)))], [*names[:-1], "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for whole in batches:
            names, held, start = whole.schema.names, [], 0
            for at, text in enumerate(whole.column(whole.num_columns - 1).to_pylist()):
                held.append(count(text))
                if sum(map(len, held)) > BATCH_CHARS or at + 1 == whole.num_rows:
                    yield batch([whole.slice(start, at + 1 - start)], held, names)
                    held, start = [], at + 1

    return run


def prefix_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, counts of every row: counts[i] is how many tokens the first i code points have, from i = 0 to the whole text.

    No shuffle: a row's counts follow from its text. Null text counts as empty
    (counts [0]); null and repeated ids keep their rows; other columns, whatever
    their names, are left out; no rows give no rows. White space, very long words
    and texts need time and memory in proportion to their length. Special tokens'
    strings in a text are one token, as the library's default has it.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(_counted(vocabulary), "doc_id long, n_bytes long, counts array<int>")


def write_counts(counts: DataFrame, path: str) -> str:
    """Store the counts: neighbouring counts differ by little, so their differences take a few bits each."""
    counts.write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").parquet(path)
    return path


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_bytes long, counts array<int>").parquet(path)


def n_tokens(counts: Column) -> Column:
    """Tokens of the whole text."""
    return F.element_at(counts, -1).cast("long")


def tokens_of_first(counts: Column, chars: int | Column) -> Column:
    """Tokens of the first so many code points (of the whole text, if it has no more)."""
    at = F.lit(chars) if isinstance(chars, int) else chars
    return F.element_at(counts, (F.least(at, F.size(counts) - 1) + 1).cast("int")).cast("long")


def longest_within(counts: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most `budget` tokens. Counts may fall where a word is completed, so the search is from the end."""
    back = F.array_position(F.transform(F.reverse(counts), lambda c: c <= budget), True)
    return F.when(n_tokens(counts) <= budget, F.size(counts) - 1).otherwise(F.size(counts) - back).cast("long")


def token_counts(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fits_chars (code points of the longest prefix within the limit), all from one count of the prefixes."""
    c = F.col("counts")
    rows = prefix_counts(docs, vocabulary)
    return rows.select("doc_id", "n_bytes", n_tokens(c).alias("n_tokens"), (n_tokens(c) > limit).alias("over_limit"), longest_within(c, limit).alias("fits_chars"))
