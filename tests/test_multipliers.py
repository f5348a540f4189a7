"""Permutation importance draws its multipliers in bounded memory."""

import math
import tracemalloc

import pytest

from ocellus.ml import protocol


@pytest.mark.parametrize("n", [0, 1, 2, 7, 60, 4001])
def test_the_first_thousand(n):
    assert protocol._multipliers(n) == ([p for p in range(max(2, n // 3), 2 * n + 10) if math.gcd(p, n) == 1][:1000] or [1])


def test_bounded_memory():
    tracemalloc.start()
    got = protocol._multipliers(10**12)
    assert len(got) == 1000 and tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()
