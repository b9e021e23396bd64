import os

import pytest

from llm import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def llm(spark):
    return common.tuned(spark)


@pytest.fixture
def rows(llm):
    """rows(schema, *tuples) -> DataFrame"""
    return lambda schema, *data: llm.createDataFrame(list(data), schema)
