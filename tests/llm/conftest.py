import pytest

from folio.runtime import ship


@pytest.fixture(autouse=True, scope="session")
def _shipped(spark):
    ship(spark)
