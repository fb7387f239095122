import pytest

ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "b", 10),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "b", 10),
    (3, None, None, None, None),
    (4, "", "de", "a", 0),
    (None, "lost text without an id", "en", None, 1),
    (5, "  \t\n ", "en", "a", 1),
    (6, "one", "en", "a", 1),
    (7, "one two", "en", "a", 1),
    (8, "word " * 30_000, "en", "long", 1),
    (9, "x" * 200_000, "en", "long", 1),
    (10, "Ünïcödé ÇA va? ÉTÉ — naïve 北京 \u00a0 \x1c ok\U0001f600", "fr", "a", 1),
    (11, "Licensed under the MIT License. All rights reserved; cc-by 4.0", "en", "a", 1),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case, and columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("n_words", "score", "labels", "node", "tokens", "bits", "chunk", "label", "a", "b", "spans", "items", "hub", "_r", "feature", "size")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
