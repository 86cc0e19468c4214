import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __id string, score double, fp string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table, with extra columns whose names clash with the operators' own."""
    def make(rows):
        full = [(i, t, "en", s, len(t or ""), "x", 9.0, "y") for i, t, s in (r if len(r) == 3 else (*r, "s0") for r in rows)]
        return spark.createDataFrame(full, DOCS).repartition(3)
    return make


# Rows every operator has to take: null id, null text, empty, white space, repeated rows, a shared id.
ODD = [(None, "alpha beta gamma delta epsilon", None), (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one two three", "b"),
       (4, "one two three", "b"), (5, "x" * 3000, "b"), (5, "other text of the same id", "b"), (6, "émile ▁ 你好 \U00010348 <|endoftext|>", "c")]


@pytest.fixture
def odd(docs):
    return docs(ODD)


@pytest.fixture
def empty(docs):
    return docs([])
