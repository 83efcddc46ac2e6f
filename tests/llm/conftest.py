import pytest

LONG = "zeta eta theta iota " * 6_000


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names the operators use inside."""
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "a"),
        (2, "alpha beta gamma delta epsilon", "en", "b"),
        (2, "alpha beta gamma delta epsilon", "en", "b"),
        (3, None, None, None),
        (4, "", "en", "a"),
        (5, LONG, "de", None),
        (6, LONG, "de", "b"),
        (7, "12345 !!", "en", ""),
        (None, "alpha beta gamma delta epsilon zeta", "en", "a"),
        (8, "É👍 ▁ \u0001 a", "fr", "c"),
    ]
    schema = "doc_id bigint, text string, lang string, source string, key int, __key int, size int, keep_id int, uid int, n int, score double, row int, t string"
    return spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0, 0.0, 0, "x") for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
