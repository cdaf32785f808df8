import pytest

#: Extra columns whose names operators use inside.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _tag int, score string, size int, kept string, row int, fp long, n_entities string"


def rows(texts, source="s", ids=None):
    return [(i if ids is None else ids[i], t, "en", source, len(t or ""), "x", 7, "y", 3, "z", 1, 5, "e") for i, t in enumerate(texts)]


@pytest.fixture
def documents(spark):
    """A table of documents from texts, with clashing extra columns; ids by place unless given."""
    return lambda texts, ids=None, source="s": spark.createDataFrame(rows(texts, source, ids), COLUMNS)


#: Empty, null, blank, tiny, repeated and very long texts.
ODD = [None, "", " \t\n", "a", "Ünï cödé 😀 text", "same words here", "same words here", "word " * 50_000, "x" * 100_000, "a\rb\x0bc\x0cd e"]
