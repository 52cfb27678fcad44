import pytest

from pressloom.plans.search import _marks, keyword_filter

ROWS = [(1, "Alpha beta", "gamma"), (2, "Été à Paris", "50% off_now"), (3, None, None), (4, "beta", "delta AND more"), (5, "gamma", None)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, title string, content string").cache()


@pytest.mark.parametrize(
    "text,default,want",
    [
        ("alpha gamma", "AND", [1]), ("alpha gamma", "OR", [1, 5]), ("alpha OU delta", "AND", [1, 4]), ('"alpha beta"', "AND", [1]), ("beta -alpha", "AND", [4]), ("beta NON alpha", "OR", [4]),
        ("(alpha OR delta) ET NOT gamma", "AND", [4]), ('"AND"', "AND", [4]), ("beta AND", "AND", [1, 4]), (")", "AND", [1, 2, 3, 4, 5]), ("alpha) nothing", "AND", [1]), ("ete", "AND", [2]), ("PARÍS", "AND", [2]),
        ("50%off", "AND", [2]), ("off_now", "AND", [2]), ("NOT gamma", "AND", [2, 4]), ("beta SAUF (alpha OR nothing)", "AND", [4]), ("alpha | delta & beta", "AND", [1, 4]),
    ],
)
def test_box(df, text, default, want):
    assert sorted(r["id"] for r in df.filter(keyword_filter(text, default)).collect()) == want


def test_blank():
    assert keyword_filter("  ") is None and keyword_filter(None) is None


def test_quoted_operator_is_an_operator_only_without_quotes():
    assert _marks('a "AND" b', "OR") == ["=a", "OR", "=AND", "OR", "=b"]
    assert _marks("a AND b", "OR") == ["=a", "AND", "=b"]
