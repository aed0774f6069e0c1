import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key long, rid long, words string, kind int, n long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text, lang, source), with extra columns of names that the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3, "w", 4, 5) for r in rows], SCHEMA)

    return make


ODD = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "one two three", "en", "a"), (3, " \n\t ", "de", None), (4, "x " * 40_000, "en", "b"), (5, "tie tie", "en", "b"), (5, "tie tie", "en", "b"), (6, "\x00é🙂 ß", "de", "c")]


@pytest.fixture
def odd():
    return ODD
