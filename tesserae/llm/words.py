"""Words of many texts as numpy arrays, and rolling hashes over them.

A word is a maximal run of bytes other than space and \\t-\\r. Hashes are polynomial sums modulo 2**64 over a random
byte table, taken for all words at once by prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_SLICE = 1 << 20
_TABLES = [np.random.Generator(np.random.PCG64(k)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for k in (11, 23)]
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_pows: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; the tables are kept up to 4 million entries."""
    got = _pows.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 1 << 22:
            _pows[base] = got
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words:
    """Words of several texts (UTF-8 bytes; None is empty): ``starts`` and ``ends`` in ``buf``, ``first[d]:first[d + 1]`` are those of text d."""

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        self.buf = b"\n" + b"\n".join(texts) + b"\n"
        space = SPACE[np.frombuffer(self.buf, np.uint8)]
        self.starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        self.ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        self.offsets = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, self.offsets)
        self.count = np.diff(self.first)
        self._hashes: dict[int, np.ndarray] = {}

    def hashes(self, kind: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, for one of two independent kinds."""
        if kind not in self._hashes:
            out, a = np.empty(len(self.starts), U), np.frombuffer(self.buf, np.uint8)
            at = 0
            while at < len(out):  # some words at a time: the arrays of a byte each stay small
                s = self.starts[at]
                to = max(at + 1, int(np.searchsorted(self.ends, s + _SLICE, "right")))
                e = self.ends[to - 1]
                up, down = _powers(_BASES[kind], e - s + 1)
                c = np.zeros(e - s + 1, U)
                np.cumsum(_TABLES[kind][a[s:e]] * up[: e - s], out=c[1:])
                i, j = self.starts[at:to] - s, self.ends[at:to] - s
                out[at:to] = mix((c[j] - c[i]) * down[i] + (j - i).astype(U))
                at = to
            self._hashes[kind] = out
        return self._hashes[kind]

    def windows(self, width: int, kind: int = 0) -> np.ndarray:
        """A hash of the ``width`` words from each word on; only those of ``inside(width)`` are of one text."""
        h = self.hashes(kind)
        n = max(len(h) - width + 1, 0)
        up, down = _powers(_BASES[1 - kind], len(h) + 1)
        c = np.zeros(len(h) + 1, U)
        np.cumsum(h * up[: len(h)], out=c[1:])
        return mix((c[width : width + n] - c[:n]) * down[:n])

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def place(self) -> np.ndarray:
        """Of each word, its number in its text."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.count)

    def inside(self, width: int) -> np.ndarray:
        """True for each word from which ``width`` words of the same text follow, itself included."""
        n = max(len(self.starts) - width + 1, 0)
        return self.place()[:n] + width <= np.repeat(self.count, self.count)[:n]
