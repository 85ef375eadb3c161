import pytest
from odd_rows import DOC, make_docs


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), DOC)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)
