"""The first later row in a range and of another brand against a scan."""

import numpy as np

from tidemark.operators.vectors import first_after


def test_first_after_equals_a_scan():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 64, 301):
        value, brands = rng.integers(0, 30, n), rng.integers(0, 3, n) * (rng.random(n) < 0.3)
        at, lo, brand = rng.integers(0, n + 1, 200), rng.integers(-2, 32, 200), rng.integers(0, 4, 200)
        hi = lo + rng.integers(0, 8, 200)
        want = [next((j for j in range(a, n) if x <= value[j] < y and brands[j] != b), -1) for a, x, y, b in zip(at, lo, hi, brand)]
        assert first_after(at, lo, hi, brand, value, brands).tolist() == want
