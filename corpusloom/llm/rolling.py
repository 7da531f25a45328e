"""Karp-Rabin fingerprints of code-point windows, for whole batches at once with NumPy."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
_POW: np.ndarray = np.ones(1, dtype=np.uint64)
_NEG: np.ndarray = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _NEG
    if len(_POW) < n:
        m = max(n, 1 << 16)
        a = np.full(m, BASE, dtype=np.uint64)
        b = np.full(m, _INV, dtype=np.uint64)
        a[0] = b[0] = 1
        _POW, _NEG = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _POW[:n], _NEG[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of fingerprints (a bijection of 64-bit numbers)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def codes(text: str) -> np.ndarray:
    """Code points of a string."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Prints:
    """Fingerprint of any window of an array in constant time: prefix sums times an inverse power."""

    def __init__(self, arr: np.ndarray):
        pos, self.neg = _powers(len(arr) + 1)
        self.sum = np.zeros(len(arr) + 1, dtype=np.uint64)
        np.cumsum((arr.astype(np.uint64) + np.uint64(1)) * pos[: len(arr)], out=self.sum[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.neg[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, q: int) -> np.ndarray:
        """Fingerprints of all windows of q."""
        n = len(self.sum) - q
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        s = np.arange(n)
        return self.at(s, s + q)


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the least fingerprint (the last of equals) in every window of w; each place once."""
    n = len(h)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(h[::-1]))], dtype=np.int64)
    v = np.lib.stride_tricks.sliding_window_view(h, w)
    return np.unique(np.arange(n - w + 1) + (w - 1 - np.argmin(v[:, ::-1], axis=1)))
