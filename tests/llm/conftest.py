import pytest
from pyspark import cloudpickle

import codesieve

cloudpickle.register_pickle_by_value(codesieve)

LONG = "word" * 30_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and columns whose names clash with inner ones."""
    same = "one two three four five six seven eight nine ten"
    rows = [(1, same), (2, same), (2, same), (3, None), (4, ""), (None, same), (5, "   \n"), (6, LONG), (7, "a b c"), (8, "123 456 --- !!"), (9, "é ñ ü")]
    return spark.createDataFrame([(i, t, "en" if i != 7 else None, i, "x", 0) for i, t in rows], "doc_id long, text string, lang string, id long, component string, n int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
