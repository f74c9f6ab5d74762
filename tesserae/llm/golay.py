"""The perfect binary Golay code (23, 12, 7): every 23-bit word is within 3 bits of just one codeword."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The syndromes of the 12 upper bits' values, and for each syndrome the error patterns of weight 4 at most and their number."""
    unit = []
    for bit in range(23):
        r = 1 << bit
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - 11)
        unit.append(r)
    upper = np.zeros(1 << 12, np.int64)
    for k in range(12):
        upper[np.arange(1 << 12) >> k & 1 == 1] ^= unit[11 + k]
    patterns = np.zeros((1 << 11, 6), np.int64)
    count = np.zeros(1 << 11, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = e = 0
            for b in bits:
                s ^= unit[b]
                e |= 1 << b
            patterns[s, count[s]] = e
            count[s] += 1
    return upper, patterns, count


def codewords(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within 4 bits of each 23-bit word: 6 columns, the nearest first, and which columns count.

    A word within 2 bits of its nearest codeword has that alone; one 3 bits away has 5 others, at 4 bits. Two words that
    differ in 2 bits at most have an index in common: the codeword nearest to a word between them is within 4 bits of both.
    If they differ in one bit, the nearest index of either is among those of the other.
    """
    upper, patterns, count = _tables()
    s = upper[x >> 11] ^ (x & 0x7FF)
    return (x[:, None] ^ patterns[s]) >> 11, np.arange(6) < count[s][:, None]
