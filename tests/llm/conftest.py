import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} tail{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties and clashing names."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (None, "", "en", "a", 0),
        (3, "", "en", "b", 0), (4, LONG, "de", "b", len(LONG)), (5, text, None, "a", 1), (None, None, None, None, None),
        (6, "   \n\t ", "en", "b", 3), (7, "Ünï ©ødé \U0001f600 text", "fr", None, 9),
    ]
    extra = ", ".join(f"{c} string" for c in (
        "score", "copies", "rate", "place", "shard", "slot", "n_words", "n_hit", "items", "spans", "kept", "fp",
        "n_values", "passages", "best", "host_failed", "difference", "hilbert", "copy_no"))
    return spark.createDataFrame([(*r, *["x"] * 19) for r in rows], f"{DOCS}, {extra}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
