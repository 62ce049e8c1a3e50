import pytest

from framewise.llm.shared import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")
