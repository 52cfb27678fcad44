"""Two tokenizers' tokens of the same text, cut where both end, and how the corpus links their ids."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.shared import Scratch, settle, texts

#: Code points and rows that share a block, whose pairs of ids are counted together.
BLOCK_CHARS, BLOCK_ROWS = 4_000_000, 1000
#: A pair of ids as one number: a * SIDE + b.
SIDE = 1 << 32

#: White space, and marks that some take for it: a generous list only cuts less.
_BLANKS = " \t-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


def _ends(spans: np.ndarray, whole: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where tokens end, in bytes: where their spans do, if they are whole characters; else so many decoded bytes after the last that is."""
    total = np.cumsum(lengths)
    last = np.maximum.accumulate(np.where(whole, np.arange(len(spans)), -1))
    return np.where(last < 0, total, np.where(whole, spans, spans[last] + total - total[last]))


class _Known(dict):
    """Chunks' numbers; an unknown chunk gets the next one and is noted as new."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        at = self[chunk] = len(self)
        self.new.append(chunk)
        return at


class Aligner:
    """Groups of the tokens that A (byte-level BPE) and B (pieces with byte fallback) have of space + text.

    Both tokenizers take a text apart at places that neither ever joins: before
    a blank or line feed that follows no white space and, where B's vocabulary
    has no piece across it, between a letter or digit and the stop or comma after
    it. Distinct chunks between such places are aligned once, many in one call,
    and kept until there are `most`. A's character offsets and B's byte spans say
    where tokens end; where tokens split a character, the lengths of their
    decoded bytes do. Groups end where tokens of both do.
    """

    def __init__(self, a: str, b: str, most: int = 500_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.most = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b), most
        byte_of = self._alphabet()
        added = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = {i: added[i].encode() if i in added else bytes(map(byte_of.__getitem__, t)) for t, i in self.a.get_vocab().items()}
        self.a_lengths = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        #: A special token's string, at which A splits before anything else, and its id.
        self.mark = next(((i, t.content) for i, t in self.a.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)), None)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, self.b_byte, strict=True)]
        self._cuts(pieces)
        self._empty()

    @staticmethod
    def _alphabet() -> dict[str, int]:
        """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on in order."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        return {chr(x): x for x in plain} | {chr(0x100 + k): x for k, x in enumerate(sorted({*range(256)} - {*plain}))}

    def _cuts(self, pieces: list[str]) -> None:
        """The places at which a text may be cut follow from B's vocabulary."""
        joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        letters = "".join(c for c in map(chr, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]) if c + "." not in joined and c + "," not in joined)
        #: Whether B never joins a line feed to anything and has no piece across words; else texts stay whole.
        self.cuts = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        stop = f"(?<=[{letters}])(?=[.,])" if letters else "(?!)"
        self.cut = re.compile(f"(?:(?!^)(?<![{_BLANKS}])(?=[ \n])|{stop})")
        #: Stops and commas that aren't cut off, and white space that takes the slower way.
        self.bound, self.odd = re.compile(f"(?<![{letters}])[.,]"), re.compile(f"[\\0{_BLANKS.removeprefix(' ').replace(chr(9) + '-', chr(9) + chr(11) + '-')}]|[ \n][ \n]")

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        text = " " + text
        if not self.cuts:
            return [text]
        if self.odd.search(text) or self.bound.search(text):
            return self.cut.split(text)
        return text[1:].replace(" ", "\0 ").replace("\n", "\0\n").replace(".", "\0.").replace(",", "\0,").join([" ", ""]).split("\0")

    def _empty(self) -> None:
        self.known = _Known()
        self.names: list[str] = []
        #: Of every chunk: tokens of A (-1: the bytes of a side aren't the chunk's) and of B, groups, links; and where its links start.
        self.sums, self.starts = np.zeros((1 << 14, 4), np.int64), np.zeros(1 << 14, np.int64)
        self.links, self.used = np.zeros(1 << 16, np.int64), 0

    def _of_a(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of the chunks in order, and where they end in the chunks' bytes."""
        together = self.mark is not None and not any(self.mark[1] in c for c in chunks)
        self.a.encode_special_tokens = not together
        texts = [self.mark[1].join(chunks[i : i + 64]) for i in range(0, len(chunks), 64)] if together else chunks
        ids, begins, ends, base = [], [], [], 0
        for text, e in zip(texts, self.a.encode_batch(texts, add_special_tokens=False), strict=True):
            i, offsets = np.array(e.ids), np.array(e.offsets).reshape(-1, 2)
            if together:
                kept = i != self.mark[0]
                offsets = offsets - len(self.mark[1]) * np.cumsum(~kept)[:, None]
                i, offsets = i[kept], offsets[kept]
                base_next = base + len(text) - len(self.mark[1]) * int((~kept).sum())
            else:
                base_next = base + len(text)
            ids.append(i)
            begins.append(offsets[:, 0] + base)
            ends.append(offsets[:, 1] + base)
            base = base_next
        ids, begins, ends = np.concatenate(ids), np.concatenate(begins), np.concatenate(ends)
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        place = np.append(0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)))
        return ids, _ends(place[ends], np.append(begins[1:] >= ends[:-1], True), self.a_lengths[ids])

    def _of_b(self, chunks: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """B's ids of the chunks in order, and where they end. A line feed goes before each chunk, which no piece joins to anything, and comes off again with the blank that B puts in front."""
        if not self.cuts:
            chunks = [c[1:] for c in chunks]
            pieces = [[(p.id, p.end + 1) for p in proto.pieces] for proto in self.b.encode(chunks, return_type="proto", num_threads=1)]
            bases = np.cumsum(sizes) - sizes
            ids = np.array([i for x in pieces for i, _ in x], np.int64)
            spans = np.array([e + base for x, base in zip(pieces, bases.tolist(), strict=True) for _, e in x], np.int64)
        else:
            proto = self.b.encode("\n" + "\n".join(chunks), return_type="proto").pieces
            ids, spans = np.array([p.id for p in proto][1:], np.int64), np.array([p.end for p in proto][1:], np.int64)
            spans = _ends(spans, ~self.b_byte[ids], np.ones(len(ids), np.int64))
            guards = np.cumsum(sizes + 1) - sizes
            guard = np.isin(spans, guards)
            ids, spans = ids[~guard], (spans - np.searchsorted(guards, spans))[~guard]
        return ids, _ends(spans, ~self.b_byte[ids], np.ones(len(ids), np.int64))

    def _learn(self, chunks: list[str], at: int) -> None:
        """Align chunks, the first of which has number `at`."""
        data = [c.encode() for c in chunks]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        (a, a_ends), (b, b_ends), bounds = self._of_a(chunks), self._of_b(chunks, sizes), np.cumsum(sizes)
        whole = b"".join(data)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            if len(chunks) > 1:
                self._learn(chunks[: len(chunks) // 2], at)
                return self._learn(chunks[len(chunks) // 2 :], at + len(chunks) // 2)
            self.names.append("")
            self.sums[at], self.starts[at] = (-1, 0, 0, 0), self.used
            return None
        cuts = np.intersect1d(a_ends, b_ends)
        of_a, of_b = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        n_a, n_b = np.bincount(of_a, minlength=len(cuts)), np.bincount(of_b, minlength=len(cuts))
        # every A token of a group with each of its B tokens
        often = n_b[of_a]
        total = int(often.sum())
        first_b = (np.cumsum(n_b) - n_b)[of_a]
        links = np.repeat(a, often) * SIDE + b[np.arange(total) - np.repeat(np.cumsum(often) - often, often) + np.repeat(first_b, often)]
        chunk = np.searchsorted(bounds, cuts)
        count = lambda weights: np.bincount(chunk, weights=weights, minlength=len(chunks)).astype(np.int64)
        n_links = count(n_a * n_b)
        self.sums[at : at + len(chunks)] = np.stack([count(n_a), count(n_b), count(None), n_links], axis=1)
        self.starts[at : at + len(chunks)] = self.used + np.cumsum(n_links) - n_links
        if self.used + total > len(self.links):
            self.links = np.pad(self.links, (0, max(total, len(self.links))))
        self.links[self.used : self.used + total] = links
        self.used += total
        x, y = [*map(str, a.tolist())], [*map(str, b.tolist())]
        names, i, j = [], 0, 0
        for k, m in zip(n_a.tolist(), n_b.tolist(), strict=True):
            names.append(f"{x[i]}|{y[j]}" if k == m == 1 else f"{','.join(x[i : i + k])}|{','.join(y[j : j + m])}")
            i, j = i + k, j + m
        ends = np.cumsum(np.bincount(chunk, minlength=len(chunks))).tolist()
        self.names += [";".join(names[p:q]) for p, q in zip([0, *ends], ends, strict=False)]
        return None

    def __call__(self, batch: list[str]) -> Iterator[tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]]:
        """Of each text: tokens of A and of B, groups and links; the groups' digest; the distinct linked pairs in order, and how often each is linked."""
        if len(self.known) > self.most:
            self._empty()
        number = self.known.__getitem__
        places = [np.fromiter(map(number, chunks), np.int64, len(chunks)) for chunks in map(self.chunks, batch)]
        if new := self.known.new:
            self.known.new = []
            if (more := len(self.known) - len(self.starts)) > 0:
                more = max(more, len(self.starts))
                self.starts, self.sums = np.pad(self.starts, (0, more)), np.pad(self.sums, ((0, more), (0, 0)))
            self._learn(new, len(self.known) - len(new))
        nothing = (0, 0, 0, 0), "", np.empty(0, np.int64), np.empty(0, np.int64)
        for at in places:
            sums = self.sums[at]
            if not len(at) or (sums[:, 0] < 0).any():
                yield nothing
                continue
            n = sums[:, 3]
            total = int(n.sum())
            links = self.links[np.arange(total) + np.repeat(self.starts[at] - (np.cumsum(n) - n), n)]
            pairs, times = np.unique(links, return_counts=True)
            digest = hashlib.sha256(";".join(map(self.names.__getitem__, at.tolist())).encode()).hexdigest()
            yield tuple(sums.sum(axis=0).tolist()), digest, pairs, times


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """One a worker process and pair of vocabulary files."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


_ROW = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, held array<long>"
_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int64()))])


def _packed(at: np.ndarray, times: np.ndarray) -> bytes:
    """Places in a block's pairs, in order, and how often each."""
    return zlib.compress(np.concatenate([np.diff(at, prepend=0), times]).astype("<u4").tobytes(), 1)


def _unpacked(links: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(zlib.decompress(links), "<u4").astype(np.int64)
    return np.cumsum(x[: len(x) // 2]), x[len(x) // 2 :]


def _blocks(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a, b)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, whole = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            start = 0
            while start < len(ids):
                stop, chars = start, 0
                while stop < len(ids) and stop - start < BLOCK_ROWS and (stop == start or chars + len(whole[stop]) <= BLOCK_CHARS):
                    chars += len(whole[stop])
                    stop += 1
                docs = [x for i in range(start, stop, 100) for x in align(whole[i : min(i + 100, stop)])]
                pairs, held = np.unique(np.concatenate([p for _, _, p, _ in docs]), return_counts=True)
                rows = [[block, i, *sums, digest, _packed(np.searchsorted(pairs, p), times), None, None] for i, (sums, digest, p, times) in zip(ids[start:stop], docs, strict=True)]
                rows[0][-2:] = pairs.tolist(), held.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                block, start = block + 1, stop

    return run


def _summed(key, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """One block's documents and what the corpus says of its pairs."""
    at = pairs.column("at").to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at], best[at] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for links in docs.column("links").to_pylist():
        i, times = _unpacked(links)
        n_best.append(int(times @ best[i]))
        count_sum.append(int(times @ count[i]))
    return docs.drop_columns(["block", "links"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def align(docs: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Documents: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum; and pairs of ids: a, b, count, best.

    Texts are aligned once, in blocks; a block's documents keep their links as
    places among the block's distinct pairs, so that a pair crosses the network
    once a block and not once a document, there and back. count says how many
    documents hold a pair linked; best, whether no other pair of its A id has a
    higher count. The commonest pair has a row for each block, an A id at most as
    many as B has ids.

    A text that is null or empty, or whose joined bytes on either side aren't
    space + text (such as one that holds U+2581), has no tokens: zeros and ''.
    Null and repeated ids keep their rows, each a document of its own. Other
    columns are left out. No rows: no rows. A text is held whole by its task.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.settle(texts(docs).mapInArrow(_blocks(a, b), _ROW), "blocks")
    held = rows.filter(F.col("pairs").isNotNull()).select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "x")).select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = scratch.settle(held.groupBy("pair").agg(F.sum("held").alias("count")), "counts")
    a_id = F.floor(F.col("pair") / F.lit(SIDE).cast("double"))
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("count").alias("highest"))
    pairs = settle(counts.withColumn("a", a_id).join(highest, "a").select("a", (F.col("pair") % SIDE).alias("b"), "count", (F.col("count") == F.col("highest")).alias("best"), "pair"), "pairs")
    back = held.drop("held").join(pairs.select("pair", "count", F.col("best").cast("long").alias("best")), "pair").select(F.col("block").alias("of"), "at", "count", "best")
    out = rows.drop("pairs", "held").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_summed, _OUT)
    out = settle(out, "aligned")
    scratch.drop()
    return out, pairs.drop("pair")
