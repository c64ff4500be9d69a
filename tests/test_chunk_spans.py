"""Chunk limits count tokens by a table of places."""

from __future__ import annotations

import numpy as np

from millrace.operators import chunk as ch


def test_parts_are_counted_without_a_search_each(monkeypatch):
    """Two searches for each part, level and chunk took most of the time of fine chunks before."""
    text = "a b. " * 2_000
    tokens = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) != 32).astype(np.int64)
    searches, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: searches.append(1) or search(*a, **k))
    found = ch.spans(text, tokens, 150, 50)
    monkeypatch.undo()
    assert len(searches) <= 1
    assert found[0][0] == 0 and found[-1][1] == len(text) and all(x[1] >= y[0] for x, y in zip(found, found[1:]))
    assert max(int(np.searchsorted(tokens, b) - np.searchsorted(tokens, a)) for a, b in found) == 150
