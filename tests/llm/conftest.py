import pytest

TEXTS = [None, "", " \n\t ", "a", "The same text, given twice.", "The same text, given twice.", "word " * 3000, "Σίσυφος ǅ \x1c\x85 don't 12km"]


@pytest.fixture
def odd_docs(spark):
    """NULLs, empty and long texts, ties, repeated rows and columns with names the operators use themselves."""
    rows = [(i, t, i, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (5, TEXTS[5], 5, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score long, spans string")


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")
