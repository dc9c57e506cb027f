from pathlib import Path

import pytest

from rowloom.llm import _shared


def rss() -> int:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


def test_freed_memory_goes_back():
    """What a task of a Python worker freed doesn't stay with the worker, even between values that live on."""
    values = [b"x" * 1000 + b"%d" % i for i in range(200_000)]
    full, kept = rss(), values[::50]
    del values
    _shared.give_back()
    assert len(kept) == 4000 and full - rss() > 100 << 20


def test_before_and_after_a_step_whatever_its_end(monkeypatch):
    seen = []
    monkeypatch.setattr(_shared, "give_back", lambda: seen.append("back"))

    def run(batches):
        for b in batches:
            seen.append(b)
            yield 1 / b

    assert list(_shared.giving_back(run)([1, 2])) == [1, 0.5] and seen == ["back", 1, 2, "back"]
    with pytest.raises(ZeroDivisionError):
        list(_shared.giving_back(run)([0]))
    assert seen[4:] == ["back", 0, "back"]
