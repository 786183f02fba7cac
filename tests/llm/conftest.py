import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, matches string, shard string, slot string, score string, size string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like those that operators add."""
    from civigrade.llm.shipping import ship

    ship(spark)
    prose = "the quick brown fox jumps over the lazy dog near the quiet river bank while seven grey geese watch from afar"
    long = " ".join(f"word{i % 977} and {i}" for i in range(40_000))
    rows = [
        (1, prose, "en", "a"),
        (2, prose, "en", "a"),
        (2, prose, "en", "a"),
        (3, prose.upper(), None, None),
        (4, "", "de", "b"),
        (5, None, "de", "b"),
        (None, prose + " again", "en", None),
        (None, None, None, None),
        (6, " \t\n", "fr", "a"),
        (7, long, "en", "c"),
        (8, long + " end", "en", "c"),
        (9, "ñandú über 漢字 " * 30, "es", "c"),
        (10, "one", "en", "a"),
        (11, "one two", "en", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "m", "s", "t", "x", "y") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.filter("doc_id < 0")


@pytest.fixture(scope="session")
def sample(spark):
    """All documents of the smallest tables."""
    from civigrade.llm.catalog import table

    return table(spark, "/root/testdata/sf0.001", "documents")
