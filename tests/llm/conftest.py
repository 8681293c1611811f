import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long, _row string, ids string, key string, size string"


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows; columns whose names clash."""
    long = " ".join(f"word{i * 7 % 997}" for i in range(30_000))
    texts = [
        None, "", " \t\n", "one", "a b c d", "A b C d", "a  b\tc\nd", "x" * 50_000, long, long + " tail",
        "same words here again " * 40, "same words here again " * 40, "é ü ß 你好 мир" * 9, "a b c d\x1ce",
        "mail me at jo.doe@mail.example.com or +1 (555) 123-4567, 10.0.0.1 and 4111 1111 1111 1111 now",
        "line one\nline two\nline one\n\nline two\n" * 8, "﻿bom text", "<|endoftext|> is text", "a.b@c.d@e.f _x@y.zz",
    ]
    rows = [(i, t, "en", f"s{i % 4}", 1, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [(100, "repeated row of words", None, None, None, None, None, None, None)] * 3
    rows += [(None, "no identifier here", None, "s1", None, None, None, None, None)] * 2
    rows += [(None, None, None, None, None, None, None, None, None)]
    rows += [(200, "first text of this id", None, "s2", 0, None, None, None, None)]
    rows += [(200, "second text of this id", None, "s2", 0, None, None, None, None)]
    rows += [(-5, "a b c d", None, "s3", 0, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ROWS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ROWS)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def corpora(odd, sample):
    """Both tables with their rows as Python sees them."""
    return [(df, [r.asDict() for r in df.collect()]) for df in (odd, sample)]
