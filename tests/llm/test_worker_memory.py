"""Memory that one operator leaves in a Python worker is free before the next one fills it."""

from assaykit.llm import common


def test_an_operator_that_takes_a_worker_over_releases_memory(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "_CACHE", {"before": {"held": 1}})
    monkeypatch.setattr(common, "release_memory", lambda: calls.append(1))
    common.worker_cache("after")
    common.worker_cache("after")
    assert calls == [1] and list(common._CACHE) == ["after"]
