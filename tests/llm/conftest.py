import pytest
from llm_rows import ROWS, SCHEMA


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "r", None, "s", "d", "h", "n") for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
