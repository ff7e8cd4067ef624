"""Wavelet matrix (Claude, Navarro and Ordonez, 2015) over a sequence of token ids, in numpy.

One bit-plane for each bit of an id, highest first; after each plane the sequence is parted stably
into zeros and ones. Planes are packed bits with a running count every 512 bits, which gives rank
in two steps, and with it access, counting and occurrence lookup on the packed form.
"""

from __future__ import annotations

import struct

import numpy as np

#: Bits between two stored counts.
STEP = 512


class WaveletMatrix:
    """planes: (width, bytes) packed bits, low bit first. zeros: 0 bits of each plane. ranks: 1 bits before every STEP-th bit."""

    def __init__(self, n: int, planes: np.ndarray, zeros: np.ndarray, ranks: np.ndarray):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        n = len(ids)
        steps = -(-n // STEP) or 1
        planes = np.zeros((width, steps * STEP // 8), np.uint8)
        zeros = np.zeros(width, np.int64)
        current = ids
        for level in range(width):
            bit = (current & ids.dtype.type(1 << (width - 1 - level))) != 0
            packed = np.packbits(bit, bitorder="little")
            planes[level, : len(packed)] = packed
            low = current[~bit]
            zeros[level] = len(low)
            if level < width - 1:
                current = np.concatenate([low, current[bit]])
        counts = np.bitwise_count(planes.reshape(width, steps, STEP // 8)).sum(axis=2, dtype=np.uint32)
        ranks = np.zeros((width, steps), np.uint32)
        np.cumsum(counts[:, :-1], axis=1, out=ranks[:, 1:])
        return cls(n, planes, zeros, ranks)

    def to_bytes(self) -> bytes:
        width, steps = self.ranks.shape
        head = struct.pack("<QIQ", self.n, width, steps)
        return head + self.zeros.astype("<i8").tobytes() + self.ranks.astype("<u4").tobytes() + self.planes.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        n, width, steps = struct.unpack_from("<QIQ", data)
        at = struct.calcsize("<QIQ")
        zeros = np.frombuffer(data, "<i8", width, at)
        at += 8 * width
        ranks = np.frombuffer(data, "<u4", width * steps, at).reshape(width, steps)
        at += 4 * width * steps
        planes = np.frombuffer(data, np.uint8, width * steps * STEP // 8, at).reshape(width, -1)
        return cls(n, planes, zeros, ranks)

    def _bits(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """1 bits of the plane before each position."""
        block = np.minimum(at // STEP, self.ranks.shape[1] - 1)
        start, wide = block * (STEP // 8), np.arange(STEP // 8)
        part = self.planes[level][start[:, None] + wide]
        bits = np.clip(at[:, None] - block[:, None] * STEP - wide * 8, 0, 8).astype(np.uint16)
        return self.ranks[level][block].astype(np.int64) + np.bitwise_count(part & ((1 << bits) - 1).astype(np.uint8)).sum(axis=1, dtype=np.int64)

    def access(self, at) -> np.ndarray:
        """The ids at the given positions."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.uint32)
        for level in range(len(self.planes)):
            bit = self._bits(level, at)
            ones = self._ones(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            out = (out << np.uint32(1)) | bit
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi, width = 0, end, len(self.planes)
        for level in range(width):
            a, b = self._ones(level, np.array([lo, hi]))
            if token >> (width - 1 - level) & 1:
                lo, hi = int(self.zeros[level] + a), int(self.zeros[level] + b)
            else:
                lo, hi = int(lo - a), int(hi - b)
        return lo, hi

    def rank(self, token: int, end: int | None = None) -> int:
        """How often the id occurs before `end`."""
        if token >> len(self.planes):
            return 0
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence (from 0); -1 if there is none."""
        if k < 0 or k >= self.rank(token):
            return -1
        at = self._range(token, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], bitorder="little", count=self.n)
            if token >> (len(self.planes) - 1 - level) & 1:
                at = int(np.flatnonzero(bits)[at - self.zeros[level]])
            else:
                at = int(np.flatnonzero(bits == 0)[at])
        return at

    def positions(self, token: int) -> np.ndarray:
        """All positions of the id, ascending."""
        if token >> len(self.planes):
            return np.zeros(0, np.int64)
        at = np.arange(*self._range(token, self.n))
        for level in range(len(self.planes) - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], bitorder="little", count=self.n)
            where = np.flatnonzero(bits) if token >> (len(self.planes) - 1 - level) & 1 else np.flatnonzero(bits == 0)
            at = where[at - (self.zeros[level] if token >> (len(self.planes) - 1 - level) & 1 else 0)]
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence: the planes undone from the last to the first."""
        width = len(self.planes)
        kind = np.uint16 if width <= 16 else np.uint32
        current = np.zeros(self.n, kind)
        for level in range(width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], bitorder="little", count=self.n).view(bool)
            undone = np.empty_like(current)
            undone[~bit] = current[: self.zeros[level]]
            undone[bit] = current[self.zeros[level] :] | kind(1 << (width - 1 - level))
            current = undone
        return current
