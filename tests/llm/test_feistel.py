import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from martflow.llm.feistel import Feistel


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 15, 16, 17, 1000, 65_537])
def test_is_a_permutation(n):
    f = Feistel(n, 7)
    p = f.permute(np.arange(n))
    assert sorted(p.tolist()) == list(range(n))
    assert f.inverse(p).tolist() == list(range(n))


@given(st.integers(1, 2**60), st.integers(0, 2**63), st.integers(0, 2**62))
def test_inverse_of_large_domains(n, key, x):
    f = Feistel(n, key)
    y = f.permute(np.array([x % n], np.uint64))
    assert y[0] < n and f.inverse(y)[0] == x % n


def test_keys_differ_and_spread():
    n = 100_000
    a, b = Feistel(n, 1).permute(np.arange(n)), Feistel(n, 2).permute(np.arange(n))
    assert (a != b).mean() > 0.99
    assert abs(np.corrcoef(a.astype(float), np.arange(n))[0, 1]) < 0.02
