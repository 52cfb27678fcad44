import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pressloom.llm import queries, variants
from tests.llm.helpers import SCHEMA, awkward, empty


def near(x, y):
    """Whether y is x with one code point inserted, deleted or replaced."""
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    short, long = sorted([x, y], key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, least=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\xc0-\xff]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            i = h % len(run)
            n[run[:i] + run[i + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if k >= least and len(w) >= 5}
    others = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(o, key=lambda v: (-n[v], v)) for w, o in others.items() if o}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, k, len(others[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w, k in n.items()}


def rows_of(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("block", [4, 1024])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(variants, "BLOCK", block)
    r = random.Random(block)
    stems = ["".join(r.choice("abéß") for _ in range(r.randint(4, 8))) for _ in range(120)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "ABABAA"]
    rows = [(i, " ".join(r.choices(stems, weights=[1 / (k + 1) for k in range(len(stems))], k=60))) for i in range(60)] + [(None, "aaaaa " * 5), (9, None), (9, ""), (99, "qqqqq " * 4 + "qqqqqq " * 9 + "qqqqqqq " * 20)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, 0.5, "x") for i, t in rows], SCHEMA)
    want = brute(rows)
    assert len({x[5] for x in want}) > 3 and any(x[5] not in (x[0], x[3]) for x in want)  # chains of forms
    assert rows_of(variants.variants(docs)) == want


@pytest.mark.parametrize("longer", range(5, 12))
def test_tiles_find_each_pair_once(longer):
    r = random.Random(longer)
    words = np.array(sorted({"".join(r.choice("ab") for _ in range(longer - r.randint(0, 1))) for _ in range(150)}), object)
    found = Counter()
    for side in "ps":
        half = longer // 2
        key = np.array([w[:half] if side == "p" else w[-half:] for w in words])
        mask = (key[:, None] == key[None, :]) & (np.arange(len(words))[:, None] < np.arange(len(words))[None, :])
        i, j = variants.near_pairs(words, words, longer, side, mask)
        found.update(zip(words[i], words[j], strict=True))
    assert found == Counter((x, y) for k, x in enumerate(words) for y in words[k + 1 :] if near(x, y) and max(len(x), len(y)) == longer)


def test_wide_code_points_and_long_words():
    words = np.array(["日本語日本", "日本語日木", "x" * 300, "x" * 299 + "y"], object)
    assert len(variants.near_pairs(words[:2], words[:2], 5, "p", np.array([[False, True], [False, False]]))[0]) == 1
    assert len(variants.near_pairs(words[2:3], words[3:], 300, "p", None)[0]) == 1


def test_awkward_and_empty(spark):
    docs = awkward(spark, [(8, "colour " * 9 + "color " * 3, "en", "a", 1, 0.5, "x")])
    got = rows_of(variants.variants(docs))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert ("color", 3, 1, "colour", 9, "colour") in got
    assert variants.variants(empty(spark)).collect() == []


def test_query_equals_its_sql(spark):
    import duckdb

    got = queries.op13_spelling_variants(spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    out = con.execute(queries.oracle_sql()["op13_spelling_variants"])
    columns = [d[0] for d in out.description]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, out.fetchall()))
