import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pressloom.llm import token_files
from pressloom.llm.shared import new_path
from tests.llm.helpers import awkward, empty

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip(spark):
    docs = awkward(spark, [(50 + i, f"text number {i} " * (i % 13), "en", "d", 1, 1.0, "x") for i in range(200)])
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    path = token_files.write_tokens(docs.repartition(5), new_path(spark, "t"), VOCABULARY, 4)
    ids = sorted((str(r["doc_id"]), r["ids"]) for r in token_files.read_tokens(spark, path).collect())
    assert ids == sorted((str(d["doc_id"]), [*t.encode(d["text"] or "", add_special_tokens=False).ids, 0]) for d in docs.collect())
    rows = sorted(map(tuple, token_files.index(spark, path).collect()), key=lambda r: (r[1], r[2]))
    at = 0
    for _, start, n, _ in rows:
        assert start == at
        at += n
    known = [r[0] for r in rows if r[0] is not None]
    assert known == sorted(known) and rows[0][0] is None
    by = {r["doc_id"]: r["ids"] for r in token_files.read_tokens(spark, path).collect()}
    assert all(crc == token_files.crc_of(np.array(by[d])) for d, _, _, crc in rows)


def test_files_are_in_order_and_filters_are_pushed(spark):
    docs = spark.createDataFrame([(i * 37 % 1000, "some words") for i in range(1000)], "doc_id long, text string")
    path = token_files.write_tokens(docs, new_path(spark, "t"), VOCABULARY, 5)
    from pyspark.sql import functions as F

    files = token_files.read_tokens(spark, path).groupBy(F.input_file_name().alias("f")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("f").collect()
    assert len(files) > 1 and all(x["b"] < y["a"] for x, y in zip(files[:-1], files[1:], strict=True))
    one = token_files.read_tokens(spark, path).filter("doc_id = 500")
    assert "EqualTo(doc_id,500)" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1


def test_empty(spark):
    assert token_files.token_files(empty(spark), VOCABULARY).count() == 0
