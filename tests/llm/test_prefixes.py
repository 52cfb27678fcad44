import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pressloom.llm import prefixes
from pressloom.llm.shared import new_path
from tests.llm.helpers import awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'", "re", "'ve", "'ll", "'s", "é", "日", "😀", "1", "23", ".", ",", "!", "The", "word", " \n", "\x1c", "\x85", "\xa0", "　", "<|endoftext|>", "<|endof", "ing", "tion", "-", "́", "​", "A", "\0"]


def encoded(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.text(max_size=20))
@settings(max_examples=400, deadline=None)
def test_every_prefix_counts_as_the_library_counts_it(text):
    assert prefixes.counter(PATH)(text).tolist() == [encoded(text[:i]) for i in range(len(text) + 1)]


def test_memory_is_emptied():
    counter = prefixes.PrefixCounter(PATH, most=3)
    for text in ["one two three four five", "six seven eight", "nine ten"]:
        assert counter(text)[-1] == encoded(text)
        assert len(counter.known) <= 5


def test_stored_counts_answer_without_the_tokenizer(spark):
    docs = awkward(spark, [(7, "Hello wonderful world, don't you'll see <|endoftext|> tomorrow", "en", "a", 5, 0.5, "z")])
    path = prefixes.write_counts(prefixes.prefix_counts(docs, PATH), new_path(spark, "counts"))
    c = F.col("counts")
    stored = prefixes.read_counts(spark, path)
    texts = {(r.doc_id, r.n): r.text for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.octet_length("text")).collect()}
    for budget in (0, 1, 3, 7, 1000):
        rows = stored.select("doc_id", "n_bytes", prefixes.n_tokens(c).alias("n"), prefixes.longest_within(c, budget).alias("fits"), prefixes.tokens_of_first(c, 10).alias("first")).collect()
        assert len(rows) == docs.count()
        for r in rows:
            text = texts[r.doc_id, r.n_bytes]
            assert (r.n, r.first) == (encoded(text), encoded(text[:10]))
            best = max(i for i in range(min(len(text), 6000) + 1) if encoded(text[:i]) <= budget) if len(text) < 6000 else None
            assert best is None or r.fits == best
            assert encoded(text[: r.fits]) <= budget


def test_awkward_and_empty(spark):
    rows = prefixes.token_counts(awkward(spark), PATH, 512).collect()
    odd = "Naïve café, ÜBER straße. 日本語 \x00 odd\x1cmarks"
    assert {(r.n_bytes, r.n_tokens, r.over_limit) for r in rows if r.doc_id in (5, 6)} == {(300_000, encoded("word " * 60_000), True), (len(odd.encode()), encoded(odd), False)}
    assert [(r.n_tokens, r.fits_chars) for r in rows if r.doc_id in (2, 3)] == [(0, 0), (0, 0)]
    assert prefixes.token_counts(empty(spark), PATH, 512).collect() == []
