

import pytest

SMALL = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, pool int, a string"

ODD = [
    (0, None),
    (1, ""),
    (2, "  \n\t "),
    (3, "one two three"),
    (4, "One TWO three"),
    (5, "the quick brown fox jumps over the lazy dog and runs away from it all day long"),
    (6, "the quick brown fox jumps over the lazy dog and runs away from it all day long"),
    (7, "the quick brown fox jumps over the lazy dog and runs away from it all day longer"),
    (8, "don't stop: it's <|endoftext|> over\n\n\n  there!!'s x"),
    (9, "日本語のテキスト é́ ß 🎉   end"),
    (10, "x" * 5000),
    (11, "word " * 9000),
    (12, "line one\nline two\n" * 300),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "s", 0, "x", 1, "b") for i, t in ODD]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


