import pytest


@pytest.fixture
def docs(spark):
    def of(rows, more=""):
        return spark.createDataFrame(rows, f"doc_id long, text string{more}")

    return of
