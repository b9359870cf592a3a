"""What a Python worker keeps between its tasks."""

from __future__ import annotations

import sys

from emberlog.llm.common import worker_cache


def test_worker_keeps_the_state_of_one_operator(monkeypatch):
    monkeypatch.setitem(sys.__dict__, "_emberlog_worker_cache", {})
    built = []
    for key in ("a", "a", "b", "b", "a"):
        assert worker_cache((key,), lambda: built.append(key) or key) == key
        assert len(sys.__dict__["_emberlog_worker_cache"]) == 1
    assert built == ["a", "b", "a"]
