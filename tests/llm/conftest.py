from __future__ import annotations

import random

import pytest


@pytest.fixture
def rng() -> random.Random:
    return random.Random(5)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents) -> dict[int, str]:
    return {r["doc_id"]: r["text"] for r in documents.collect()}


#: Rows that every operator has to take: null, empty, blank, repeated and clashing ones.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three"), (4, "one two three"), (5, "ONE two Three"), (None, "one two three"), (6, "x" * 5000), (7, "日本語 テキスト 😀 é"), (8, "a\x1cb\x85c d e f g h")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, 7, "clash") for r in ODD], "doc_id long, text string, n long, score string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
