"""Rolling 64-bit hashes over arrays of code points or words."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 18
BASE = 0x9E3779B97F4A7C15
MULT = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= MULT
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of all stretches of an array: sums of c[i+j] * BASE**-j modulo 2**64, then mixed."""

    def __init__(self) -> None:
        self.size = 0

    def grow(self, n: int) -> None:
        if n > self.size:
            n = max(n, CHUNK)
            up, down = np.full(n + 1, np.uint64(BASE)), np.full(n + 1, np.uint64(pow(BASE, -1, 1 << 64)))
            up[0] = down[0] = 1
            self.up, self.down, self.size = np.multiply.accumulate(up), np.multiply.accumulate(down), n

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        self.grow(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(0x51ED)) * self.down[: len(codes)], out=sums[1:])
        return sums

    def between(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((sums[stop] - sums[start]) * self.up[start] + (stop - start).astype(np.uint64))

    def grams(self, codes: np.ndarray, length: int) -> np.ndarray:
        sums = self.prefix(codes)
        return mix((sums[length:] - sums[:-length]) * self.up[: len(codes) - length + 1])


ROLLING = Rolling()
