import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs or whole rows."""

    def build(rows):
        full = [(r if len(r) == 5 else (r[0], r[1], "en", "web", len(r[1] or ""))) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
    return [
        (1, None, "en", "web", 0),
        (2, "", None, None, 0),
        (3, " \t\n ", "en", None, None),
        (4, "one", "en", "web", 3),
        (5, "Two words", None, "web", 9),
        (6, long, "en", "web", len(long)),
        (7, long, "de", "web", len(long)),
        (8, "tie tie tie tie tie tie tie tie tie tie", "en", "web", 40),
        (8, "tie tie tie tie tie tie tie tie tie tie", "en", "web", 40),
        (None, "a text without a name", "en", "web", 21),
        (9, "é 漢字 ﬁ ́ 😀\x00<s>", "fr", "book", 12),
    ]
