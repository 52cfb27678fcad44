"""Documents with everything that must not crash an operator."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, extra string"


def awkward(spark, more=()):
    """Nulls in any column, empty and very long texts, repeated rows, clashing column names."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10, 1.0, "x"),
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10, 1.0, "x"),
        (2, "", None, "a", 0, None, None),
        (3, None, "en", None, None, None, None),
        (4, "  \n\t ", "en", "b", 4, 0.0, "y"),
        (5, "word " * 60_000, "en", "b", 300_000, 0.0, "y"),
        (None, "no id but text", "en", "b", 14, 0.5, "z"),
        (6, "Naïve café, ÜBER straße. 日本語 \x00 odd\x1cmarks", "fr", "c", 30, 0.5, "z"),
        *more,
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
