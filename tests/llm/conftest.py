import pytest

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    prose = ("the quick brown fox jumps over the lazy dog near a quiet river bank while seven small birds watch from "
             "tall green trees and nobody says a single word until evening falls over distant hills again today " * 3)
    rows = [
        (1, prose + "one", "en", "s1", 1), (2, prose + "one", "en", "s1", 1), (2, prose + "one", "en", "s1", 1),
        (3, None, None, None, None), (4, "", "de", "s2", 0), (None, prose + "two", "fr", None, 5), (None, None, None, None, None),
        (5, LONG, "es", "s2", 9), (6, "### *** %%% $$$ " * 40, "en", "s1", 3), (7, "same line here\n" * 80, "de", "s3", 4),
        (8, "Ünïcödé ñandú çela " * 30, "fr", "s3", 2), (9, prose.upper(), "en", "s1", 1), (10, " \n\t ", "en", "s1", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = ("kept", "size", "target", "start", "words", "score", "fp", "spans", "n", "h", "key", "shard", "epochs")
    for name in clash:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df.cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


def rows_of(df):
    return [tuple(r) for r in df.collect()]
