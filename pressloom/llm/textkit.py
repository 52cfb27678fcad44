"""Words, 64-bit hashes and memoised tokenisation for batches of texts inside tasks."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_30, _27, _31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (splitmix64)."""
    x = x + _A
    x = (x ^ (x >> _30)) * _B
    x = (x ^ (x >> _27)) * _C
    return x ^ (x >> _31)


def words(text: str, lower: bool = False) -> list[bytes]:
    """Runs of characters other than space and U+0009 to U+000D; lower changes A-Z only."""
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n word hashes, in order."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1]
    for i in range(1, n):
        out = mix(out * _B + h[i : len(h) - n + 1 + i])
    return out


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; a shorter text is one shingle, one without words none."""
    h = hashes(words(text, lower=True))
    return np.unique(ngrams(h, min(n, len(h)))) if len(h) else h


#: The white space of the vocabularies' own pattern.
BLANKS = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space other than blanks and line feeds, marks that Python alone takes for white space, and two of white space together.
_ODD = [*"\0\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)), "  ", "\n\n", " \n", "\n "]
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: A full stop or comma that doesn't follow a letter or digit, and so may be one token with what it follows.
_BOUND = re.compile(r"[.,](?<![^\W_][.,])")
#: Beyond this, lower case is left to the tokenizer.
_WIDE = re.compile("[^\\x00-\u012f]")


class _Known(dict):
    """Chunks' numbers; an unknown chunk gets the next one and is noted as new."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        at = self[chunk] = len(self)
        self.new.append(chunk)
        return at


class Encoder:
    """Token ids of texts, each distinct chunk (white space and the word after it) encoded once.

    Public byte-level and word-end BPE vocabularies never merge across the end
    of a word, nor a letter or digit with the stop or comma after it, so the ids
    of a text are those of its chunks in order; white space keeps to the front of
    its chunk, where the tokenizer sees what it sees in the text. A vocabulary
    that drops white space and case gets chunks without them. The memory of
    chunks is emptied beyond `most` entries.
    """

    def __init__(self, path: str, most: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.encode_special_tokens = True
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.drops = ids(" Word\n") == ids("word")
        added = self.tokenizer.get_added_tokens_decoder()
        plain = [i for i, a in added.items() if a.special and not (a.lstrip or a.rstrip or a.single_word)]
        #: Special tokens' strings, one to put between chunks first; and its id.
        self.marks = [added[plain[0]].content, *[a.content for a in added.values()]] if plain else []
        self.mark = np.array(plain[:1], np.uint32)
        self._empty()

    def _empty(self) -> None:
        self.known = _Known()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self) -> None:
        new, self.known.new = self.known.new, []
        lengths, ids = self._encoded(new)
        at, end = len(self.known) - len(new), len(self.known)
        if end > len(self.starts):
            grow = max(end, 2 * len(self.starts)) - len(self.starts)
            self.starts, self.lengths = np.pad(self.starts, (0, grow)), np.pad(self.lengths, (0, grow))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.pad(self.flat, (0, max(len(ids), len(self.flat))))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[at:end], self.lengths[at:end] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += len(ids)

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and all of them.

        Chunks are encoded by the dozen, with a special token between them, at
        which the tokenizer splits a text before anything else.
        """
        together = bool(self.marks) and not any(m in c for c in new for m in self.marks)
        self.tokenizer.encode_special_tokens = not together
        size = 64 if together else 1
        texts = [self.marks[0].join(new[i : i + size]) for i in range(0, len(new), size)] if together else new
        encoded = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.tokenizer.encode_special_tokens = True
        if not together:
            return np.fromiter(map(len, encoded), np.int64, len(encoded)), np.concatenate(encoded)
        ids = np.concatenate([x for e in encoded for x in (e, self.mark)])
        ends = np.flatnonzero(ids == self.mark[0])
        return np.diff(np.append(-1, ends)) - 1, ids[ids != self.mark[0]]

    def chunks(self, text: str) -> list[str]:
        if any(map(text.__contains__, _ODD)):
            return _CHUNK.findall(text)
        stops = not _BOUND.search(text)
        if self.drops:
            if not _WIDE.search(text):
                text = text.lower()
            return (text.replace(".", " .").replace(",", " ,") if stops else text).split()
        if stops:
            text = text.replace(".", "\0.").replace(",", "\0,")
        return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")

    def __call__(self, batch: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.most:
            self._empty()
        number = self.known.__getitem__
        places = [np.fromiter(map(number, p), np.int64, len(p)) for p in map(self.chunks, batch)]
        if self.known.new:
            self._learn()
        out = []
        for at in places:
            n = self.lengths[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.arange(total) + np.repeat(self.starts[at] - (ends - n), n)])
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
