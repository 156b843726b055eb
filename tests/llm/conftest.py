import pytest

from fathom.session import session

#: Columns that clash with names the operators use inside.
CLASH = "score double, predicted int, size bigint, key string, place bigint, n bigint, id string, rep bigint, media binary, lang_pred string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = session("local[4]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{shared}", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    return s


def frame(spark, rows):
    """Documents of (doc_id, text, lang, source), with clashing columns."""
    return spark.createDataFrame([(*r, None, 1.5, 3, 4, "k", 5, 6, "x", 7, None, "zz") for r in rows], SCHEMA)


ODD = [
    (1, "The cat sat on the mat and the dog ran off. " * 3, "en", "a"), (2, None, "en", None), (3, "", None, "a"), (4, "   \n\t ", "en", "b"),
    (5, "one", "en", "b"), (5, "one", "en", "b"), (None, "no id here at all, none", None, None), (None, None, None, None),
    (6, "wörter über straße 日本語 🎉 é", "de", "c"), (7, "long " * 30_000, "en", "c"), (8, "The cat sat on the mat and the dog ran off. " * 3, "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
