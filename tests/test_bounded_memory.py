"""Memory of a task is set by the curves it solves at a time, not by those of a batch."""

import tracemalloc

import numpy as np
import pandas as pd

from beadloom.operators import fits


def peak_mb(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_splines_of_a_large_batch_are_solved_in_parts():
    rng = np.random.default_rng(3)
    sizes = [3, 5] + [200] * 4000 + [1]
    xs = pd.Series([np.cumsum(rng.uniform(0.1, 1.0, n)) for n in sizes])
    ys = pd.Series([rng.normal(size=n) for n in sizes])
    got, peak = peak_mb(lambda: fits._curvature.func(xs, ys))
    assert peak < 25  # 6.4 MB are the result
    for k in (0, 1, 2, 2000, len(sizes) - 1):
        alone = fits._curvature.func(xs.iloc[[k]], ys.iloc[[k]])
        assert np.array_equal(got.iloc[k], alone.iloc[0])
