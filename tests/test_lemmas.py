"""Lemmas by dictionary, by learned suffix rules, by neither."""

from collections import Counter

from pressloom.operators import lemmas

PAIRS = [("cats", "cat"), ("dogs", "dog"), ("cities", "city"), ("parties", "party"), ("walking", "walk"), ("talking", "talk"), ("was", "be"), ("glass", "glass"), ("class", "class"), ("house", "house"), ("табу", "табу"), ("книги", "книга"), ("ноги", "нога"), (None, "x"), ("x", None)]


def brute(words, pairs, context=4, least=2):
    """Lemmas by loops over all pairs."""
    known = {}
    for w, v in pairs:
        if w and v:
            known[w] = min(known.get(w, v), v)
    rules = {}
    for w, v in known.items():
        p = 0
        while p < min(len(w), len(v)) and w[p] == v[p]:
            p += 1
        for at in range(p, max(p - context, 0) - 1, -1):
            rules.setdefault(w[at:], Counter())[v[at:]] += 1
    best = {s: min(c, key=lambda e: (-c[e], e)) for s, c in rules.items() if max(c.values()) >= least}
    best = {s: e for s, e in best.items() if rules[s][e] >= least}

    def one(w):
        if w in known:
            return known[w]
        for at in range(len(w) + 1):
            if w[at:] in best:
                return w[:at] + best[w[at:]]
        return w

    return [one(w) for w in words]


def test_equals_brute_force(spark):
    words = ["cats", "birds", "berries", "jumping", "was", "grass", "mouse", "zzz", "дороги", "ing", "s", "ies", "x", "a" * 300 + "s"]
    tokens = spark.createDataFrame([*((w, i) for i, w in enumerate(words)), ("birds", 99), (None, 100), ("", 101)], "token string, at int")
    got = {r.at: r.token for r in lemmas.lemmatise(tokens, spark.createDataFrame(PAIRS, "word string, lemma string")).collect()}
    assert [got[i] for i in range(len(words))] == brute(words, PAIRS)
    assert (got[1], got[2], got[8], got[99], got[100], got[101]) == ("bird", "berry", "дорога", "bird", None, "")


def test_without_a_dictionary(spark):
    tokens = spark.createDataFrame([("cats",), ("dogs",)], "token string")
    none = spark.createDataFrame([], "word string, lemma string")
    assert sorted(r.token for r in lemmas.lemmatise(tokens, none).collect()) == ["cats", "dogs"]
    assert lemmas.lemmatise(tokens.limit(0), none).collect() == []
