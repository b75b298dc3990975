import pytest

from threadloom.llm import common


@pytest.fixture(autouse=True)
def _package(spark):
    common.ship_package(spark)
