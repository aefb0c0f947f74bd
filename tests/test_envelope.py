"""The function of one pattern against all distances."""

from __future__ import annotations

import numpy as np
import pytest

from histomesh.operators import patterns as pt


def brute(function, pts, r, rng):
    d = np.hypot(*(pts[:, None] - pts[None]).transpose(2, 0, 1))
    area = np.ptp(pts[:, 0]) * np.ptp(pts[:, 1])
    if function in "KL":
        k = area / (len(pts) * (len(pts) - 1)) * ((d[:, :, None] <= r).sum(axis=(0, 1)) - len(pts))
        return k if function == "K" else np.sqrt(k / np.pi) - r
    if function == "G":
        np.fill_diagonal(d, np.inf)
        return (d.min(axis=1)[:, None] <= r).mean(axis=0)
    at = np.column_stack([rng.uniform(pts[:, k].min(), pts[:, k].max(), len(pts)) for k in (0, 1)])
    return (np.hypot(*(at[:, None] - pts[None]).transpose(2, 0, 1)).min(axis=1)[:, None] <= r).mean(axis=0)


@pytest.mark.parametrize("function", "KLGF")
def test_pattern(function):
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.exponential(20, (150, 2)), rng.uniform(0, 90, (50, 2)), [[3.0, 3.0], [3.0, 3.0]]])
    for top in (2.0, 25.0):
        r = np.arange(1, 11) * top / 10
        assert np.allclose(pt._pattern(function, pts, r, np.random.default_rng(1)), brute(function, pts, r, np.random.default_rng(1)))

    line = np.column_stack([np.arange(4.0), np.zeros(4)])
    assert pt._pattern("G", line, np.zeros(3), rng).tolist() == [0.0] * 3


def test_no_distances_of_all_pairs():
    """20000 points, as one cluster of the events has, 10 times: all distances would take minutes."""
    import time

    pts, began = np.random.default_rng(0).uniform(0, 700, (20_000, 2)), time.process_time()
    for _ in range(10):
        pt._pattern("G", pts, np.arange(1, 21) / 5, np.random.default_rng(1))
    assert time.process_time() - began < 10
