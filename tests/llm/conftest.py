"""Tests share one session: what a test sets in it is set back."""

import pytest


@pytest.fixture(autouse=True)
def _settings_stay(request):
    if "spark" not in request.fixturenames:
        yield
        return
    conf = request.getfixturevalue("spark").conf
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key, None)
    yield
    conf.unset(key) if before is None else conf.set(key, before)
