import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: nulls, empties, ties, repeated rows, control strings, non-ASCII, a long text
ODD = [(1, "Hello world, hello World"), (2, None), (3, ""), (4, "   \n\t"), (5, "a\n\nb  c \n"), (6, "<|endoftext|> <|im_end|>[INST] \\0 </s>"),
       (7, "日本語 テキスト 😀😀 ÀÉ"), (8, "word " * 30_000), (9, "Hello world, hello World"), (10, "x"), (11, "It's we'll 12345 -- ok. ok")]


@pytest.fixture
def odd(spark):
    """Documents with edge cases and extra columns whose names clash with operators' own."""
    rows = [(d, t, "en", 1, "q") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, h1 int, _id string")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def by(df, *cols, key="doc_id"):
    return {r[key]: tuple(r[c] for c in cols) for r in df.collect()}
