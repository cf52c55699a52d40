"""The order of suffixes against a plain sort."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from keyfold.llm import difference_cover as dc


@settings(max_examples=150, deadline=None)
@given(st.text("ab\0", min_size=1, max_size=120), st.integers(7, 40))
def test_order_and_ties(text, length):
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts = np.arange(max(0, len(raw) - length + 1))
    order = dc.sort_suffixes(data, starts)
    found = [raw[i : i + length] for i in order]
    assert sorted(order) == list(starts) and found == sorted(found)
    same = dc.equal_neighbours(data, order, length)
    assert same.tolist() == [k > 0 and found[k] == found[k - 1] for k in range(len(found))]


@pytest.mark.parametrize("seed", range(3))
def test_repetitive_text(seed):
    rng = np.random.default_rng(seed)
    data = np.concatenate([np.tile(rng.integers(0, 3, 5), 300), rng.integers(0, 2, 2000)] * 2).astype(np.uint8)
    starts = np.sort(rng.choice(len(data) - 100, 3000, replace=False))
    order = dc.sort_suffixes(data, starts)
    found = [data[i : i + 100].tobytes() for i in starts[order]]
    assert found == sorted(found)
