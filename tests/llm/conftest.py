import pytest

TEXT = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew strange potions in the cellar of a ruined tower near the northern sea"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``(doc_id, text[, source])`` rows, with the columns of the table and
    two that clash with names the operators use."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", 5) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, `score` string, key int")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return [(1, None), (2, ""), (None, TEXT), (3, TEXT), (3, TEXT), (4, TEXT), (5, " \t\n\x0b "), (6, "word " * 60_000), (7, "ä\x00b \U0001f600"), (None, None)]
