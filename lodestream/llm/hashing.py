"""Hashes of the words of many texts at once, for the operators that work on Arrow batches."""

from __future__ import annotations

import numpy as np

from .linear import mixed

#: Bytes for which the running powers are kept; they grow for a longer chunk and shrink after it.
_BYTES = 1 << 18
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: The word hash is a polynomial in this odd number, so it has an inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15


class Hasher:
    """Hashes all words of a chunk of text at once, from running sums over its bytes."""

    def __init__(self) -> None:
        self.value = mixed(np.arange(256, dtype=np.uint64), salt=11)
        self._grow(_BYTES + (_BYTES >> 2))

    def _grow(self, size: int) -> None:
        self.up, self.down = (np.full(size, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        for powers in (self.up, self.down):
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words start, and their hashes."""
        octets = np.frombuffer(data, np.uint8)
        edges = np.diff(np.concatenate([[False], ~_SPACE[octets], [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if len(octets) > len(self.up):
            self._grow(len(octets))
        sums = np.zeros(len(octets) + 1, np.uint64)
        np.cumsum(self.value[octets] * self.up[: len(octets)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * self.down[starts]
        if len(self.up) > 4 * _BYTES:
            self._grow(_BYTES + (_BYTES >> 2))
        return starts, mixed(found, (ends - starts).astype(np.uint64), salt=12)
