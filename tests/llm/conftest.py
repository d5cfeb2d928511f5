import pytest


@pytest.fixture(autouse=True)
def swept(spark):
    yield
    from trailmark.llm.common import sweep

    sweep(spark)
