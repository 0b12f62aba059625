import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rule string, id string, n string"

LONG = " ".join(f"word{i}x" for i in range(6000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, None, "en", "a", None, "x", "y", "z"),
        (2, "", "en", None, 0, None, None, None),
        (3, LONG, None, "a", 5, "x", "y", "z"),
        (4, "the cat sat on the mat and the dog", "en", "a", 1, "x", "y", "z"),
        (4, "the cat sat on the mat and the dog", "en", "a", 1, "x", "y", "z"),
        (None, "the cat sat on the mat and the dog", "en", "a", 1, "x", "y", "z"),
        (6, "\n \t", "de", "b", 1, "x", "y", "z"),
        (7, "123 456 !!", "de", "b", 1, "x", "y", "z"),
        (8, "it's <|endoftext|>  ünïcode\u3000😀 x", "de", "b", 1, "x", "y", "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
