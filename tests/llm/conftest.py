import pytest

from martflow.llm import shared


@pytest.fixture(autouse=True)
def _no_pauses(monkeypatch):
    """Small tests leave no shuffle files worth waiting for."""
    monkeypatch.setattr(shared, "PAUSE", 0.0)
