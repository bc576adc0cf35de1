import pytest


@pytest.fixture(scope="session")
def cases(spark):
    """Document analyses by case: ``cases([(case_id, raw_text), ...])``."""

    def make(rows, schema="case_id long, raw_text string"):
        return spark.createDataFrame(rows, schema)

    return make
