import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from pressloom.llm import rules
from tests.llm.helpers import awkward, empty


def plain(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {p for i in range(len(ws) - 2) if wins[tuple(ws[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup, lines = dup + (line in seen), lines + 1
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), lines, dup, len(hit), len(re.findall("[A-Z]", text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab A#|<\n\t\x85\xa0é ", max_size=60))
def test_measure(text):
    assert rules.measure(text) == plain(text)


def test_ledger_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(80))
    docs = awkward(spark, [(20, good, "en", "a", 1, 1.0, "x"), (21, good.upper(), "en", "a", 1, 1.0, "x"), (22, "| ".join(f"w{i}" for i in range(80)), "en", "a", 1, 1.0, "x"), (23, "same line here\n" * 40, "en", "a", 1, 1.0, "x")])
    entries = rules.ledger(docs).cache()
    bits = {r["doc_id"]: r["failed"] for r in entries.collect()}
    assert bits[20] == 0 and bits[21] & rules.BIT["shouting"] and bits[22] & rules.BIT["symbols"] and bits[23] & rules.BIT["repeated_lines"]
    assert bits[2] == bits[3] == bits[4] == rules.BIT["few_words"]
    rows = {(r["version"], r["rule"]): r for r in rules.ablations(entries, [rules.BASE, rules.WEB]).collect()}
    assert len(rows) == len(rules.BASE.rules) + len(rules.WEB.rules)
    all_bits = [r["failed"] for r in entries.collect()]
    for p in (rules.BASE, rules.WEB):
        for r in p.rules:
            row = rows[p.version, r]
            assert row["failing"] == sum(bool(b & rules.BIT[r]) for b in all_bits)
            assert row["kept"] == sum(not b & p.mask for b in all_bits)
            assert row["kept_without"] == sum(not b & (p.mask & ~rules.BIT[r]) for b in all_bits)
    kept = rules.keep_passing(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {20, None}
    assert rules.ledger(empty(spark)).count() == 0
