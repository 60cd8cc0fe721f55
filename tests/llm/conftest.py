"""Settings that a user of the corpus operators gives."""

import pytest


@pytest.fixture(autouse=True)
def pii_key(request):
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").conf.set("spark.lorekeep.pii.key", "a key for tests")
