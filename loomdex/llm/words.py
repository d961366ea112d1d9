"""Kernels on words, shared by the operators that work on word sequences.

A word is ``[^\\x20\\x09-\\x0D]+``. ``bytes.split()`` splits UTF-8 text on exactly
these six characters, because bytes of longer UTF-8 sequences are never ASCII.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import xxhash


class Remembered(dict):
    """What a function makes of short texts, remembered.

    There are two generations of at most ``most`` texts: when the younger is full it becomes the
    older, and texts that are met again become young again. So frequent ones stay.
    """

    def __init__(self, make: Callable[[str], object], most: int, longest: int):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, text: str):
        value = self.older.get(text)
        if value is None:
            value = self.make(text)
        if len(text) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[text] = value
        return value


def hashed(words: Iterable[bytes], n: int) -> np.ndarray:
    """The 64-bit hash of each of ``n`` words. Computing one takes less time than finding it among those seen before."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` consecutive items, in order of its start."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 0x243F6A8885A308D3, np.uint64)
    tmp = np.empty(n, np.uint64)
    for j in range(k):
        np.bitwise_xor(out, hashes[j : j + n], out=out)
        np.multiply(out, np.uint64(0x9E3779B97F4A7C15), out=out)
        np.right_shift(out, np.uint64(29), out=tmp)
        np.bitwise_xor(out, tmp, out=out)
    return out
