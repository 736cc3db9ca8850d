"""A keyed permutation of 0 .. n - 1: a balanced Feistel network on the next even number of bits, with cycle-walking."""

from __future__ import annotations

import numpy as np

from martflow.llm.shared import BASE, mix64

ROUNDS = 6


def round_keys(key: int) -> np.ndarray:
    return mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * BASE + mix64(np.array([key & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


class Feistel:
    """permute() maps any array of integers below n to distinct integers below n; inverse() undoes it.

    A value that the network sends to n or above goes through it again until it falls below n. The network permutes the
    next power of 4 above n, so this takes under four turns on average and always ends.
    """

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = round_keys(key)

    def _turn(self, x: np.ndarray, keys) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for k in keys:
            a, b = b, a ^ (mix64(b + k) & self.mask)
        return (b << self.half) | a  # the halves change sides, so that the reversed keys undo it

    def _walk(self, x, keys) -> np.ndarray:
        x = np.asarray(x, np.uint64)
        if self.n <= 1:
            return np.zeros_like(x)
        out = self._turn(x, keys)
        while (far := np.flatnonzero(out >= self.n)).size:
            out[far] = self._turn(out[far], keys)
        return out

    def permute(self, x) -> np.ndarray:
        return self._walk(x, self.keys)

    def inverse(self, x) -> np.ndarray:
        return self._walk(x, self.keys[::-1])
