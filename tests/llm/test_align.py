import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pressloom.llm import align
from tests.llm.helpers import SCHEMA, awkward, empty

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER, PIECES = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
TOKENIZER.encode_special_tokens = True
PARTS = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "'", "re", "é", "日本", "😀", "ẞ", "1", "23", ".", ",", "!", "The", "word", " \n", "\x1c", "\x85", "\xa0", "　", "▁", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "ing", "#", "́", "\0", "ﬁ", "\r\n", "e.g.", "word,", "한", "ก"]


def tokens(ids, bytes_of, want):
    """(id, end in bytes) of every token; None if the bytes aren't the text's."""
    parts = [bytes_of[i] for i in ids]
    ends = [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
    return [*zip(ids, ends, strict=True)] if b"".join(parts) == want else None


def brute(text):
    """Groups of a text from whole encodings alone."""
    side, want = align.aligner(A, B), (" " + (text or "")).encode()
    a = tokens(TOKENIZER.encode(" " + (text or ""), add_special_tokens=False).ids, side.a_bytes, want)
    b = tokens(PIECES.encode(text or ""), side.b_bytes, want)
    if not text or a is None or b is None:
        return []
    cuts = sorted({e for _, e in a} & {e for _, e in b})
    return [([i for i, e in a if start < e <= end], [i for i, e in b if start < e <= end]) for start, end in zip([0, *cuts], cuts, strict=False)]


def digest(groups):
    name = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return hashlib.sha256(name.encode()).hexdigest() if groups else ""


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=20), max_size=3))
@settings(max_examples=300, deadline=None)
def test_chunks_give_what_whole_texts_give(batch):
    for text, (sums, name, pairs, times) in zip(batch, align.aligner(A, B)(batch), strict=True):
        groups = brute(text)
        links = Counter(a * align.SIDE + b for x, y in groups for a in x for b in y)
        assert sums == (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()))
        assert name == digest(groups) and dict(zip(pairs.tolist(), times.tolist(), strict=True)) == links


def test_corpus_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_ROWS", 3)
    texts = ["the cat sat, the mat", "the cat", "don't stop 日本 naïve", "x" * 50, "<|endoftext|> </s>", "a ▁ b", "été\n\nété  é", None, "", " the the", "😀😀 the"]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, 0.5, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3, "doc_id")
    out, pairs = align.align(docs, A, B)
    groups = {i: brute(t) for i, t in enumerate(texts)}
    links = {i: Counter((a, b) for x, y in g for a in x for b in y) for i, g in groups.items()}
    count = Counter(p for x in links.values() for p in x)
    top = {a: max(n for (x, _), n in count.items() if x == a) for a, _ in count}
    want = {(i, sum(links[i].values()), sum(n for (a, b), n in links[i].items() if count[a, b] == top[a]), sum(n * count[p] for p, n in links[i].items()), digest(groups[i])) for i in groups}
    assert {(r.doc_id, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()} == want
    assert {(r.a, r.b): (r["count"], r.best) for r in pairs.collect()} == {p: (n, n == top[p[0]]) for p, n in count.items()}


def test_awkward_and_empty(spark):
    rows = align.align(awkward(spark), A, B)[0].collect()
    assert len(rows) == awkward(spark).count()
    assert {(r.n_a, r.n_b, r.groups_sha256, r.count_sum) for r in rows if r.doc_id in (2, 3)} == {(0, 0, "", 0)}
    assert [r for r in rows if r.doc_id == 5][0].n_links > 60_000
    assert len({(r.n_a, r.count_sum) for r in rows if r.doc_id == 1}) == 1
    assert [x.collect() for x in align.align(empty(spark), A, B)] == [[], []]
