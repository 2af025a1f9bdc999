import pytest
from .odd_rows import ODD_DOCS, SCHEMA

from updraft.llm.tables import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def odd(spark):
    """The odd documents with extra columns named like columns of results."""
    docs = spark.createDataFrame(ODD_DOCS, SCHEMA)
    return docs.selectExpr("*", "'x' AS score", "1 AS slot", "2 AS n", "'y' AS id", "'z' AS rule")


@pytest.fixture
def none(odd):
    return odd.limit(0)
