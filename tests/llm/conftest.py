import pytest

CASES = ["", None, " ", "\n", "a", "word " * 30, "Ünïcödé ẞ 日本 \U0001f600 x", "one two three four five", "one two three four five", "password=abc123", "x" * 5000, "a  b\t\tc \n d"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeats, and extra columns whose names operators use inside."""
    rows = [(k, t, None if k % 2 else "en", None, None if t is None else len(t), "x", 1) for k, t in enumerate(CASES)]
    rows.append((len(CASES), "long line of many words " * 4000, "en", "src", 96000, None, None))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, spans int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
