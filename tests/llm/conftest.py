from __future__ import annotations

import pytest

from loadspan.llm.common import configure
from loadspan.llm.queries import BYTE_BPE, PIECES, WORD_BPE, tokenizer


@pytest.fixture(scope="session")
def word_bpe() -> str:
    return tokenizer(WORD_BPE)


@pytest.fixture(scope="session")
def byte_bpe() -> str:
    return tokenizer(BYTE_BPE)


@pytest.fixture(scope="session")
def pieces() -> str:
    return tokenizer(PIECES)


@pytest.fixture
def docs(spark):
    """Documents from texts, with ids from 0 and columns whose names clash with results."""
    configure(spark)

    def build(texts, ids=None):
        rows = [(i, t, "en", "x", -1.0, -1, "mine") for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(
            rows, "doc_id bigint, text string, lang string, source string, score double, n bigint, component string",
        ).repartition(3)

    return build


@pytest.fixture(scope="session")
def given(spark, sf_dir):
    configure(spark)
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
