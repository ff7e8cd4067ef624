"""Word shingles as 64-bit hashes, and SetSketch registers over them (Ertl, 2021), in numpy.

A register is the least of a hash over the set, truncated to exponentially spaced levels: the larger
the least value's level, the larger the set. Registers of a union are the elementwise maximum, and
registers of similar sets agree often, so bands of them serve as locality-sensitive keys.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Registers, base of the spacing (2 ** (1 / 8): 8 levels an octave, 256 levels in all), registers a band.
REGISTERS, LEVELS_AN_OCTAVE, BAND = 128, 8, 4
BASE = 2 ** (1 / LEVELS_AN_OCTAVE)
#: An odd multiplier of the polynomial hash, and those that weigh a shingle's words.
POWER = 0x9E3779B97F4A7C15
WEIGHTS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\r\x0b\x0c", bytes(range(97, 123)) + b"     ")
PIECE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(POWER, PIECE + 2), _powers(pow(POWER, -1, 2**64), PIECE + 2)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * WEIGHTS[0]
    x = (x ^ (x >> np.uint64(27))) * WEIGHTS[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word: runs of bytes other than the ASCII blanks, A-Z lower-cased."""
    text = raw.translate(_LOWER)
    if len(text) > PIECE - 2:
        cuts, at = [], 0
        while at < len(text):
            end = min(len(text), at + PIECE - 2)
            if end < len(text):
                found = text.rfind(b" ", at, end)
                if found < 0:  # a word longer than a piece: hashed whole
                    import hashlib

                    stop = text.find(b" ", end)
                    stop = len(text) if stop < 0 else stop
                    cuts.append(np.frombuffer(hashlib.blake2b(text[at:stop], digest_size=8).digest(), "<u8"))
                    at = stop + 1
                    continue
                end = found + 1
            cuts.append(word_hashes(text[at:end]))
            at = end
        return np.concatenate(cuts) if cuts else np.zeros(0, np.uint64)
    codes = np.frombuffer(b" " + text + b" ", np.uint8)
    edge = np.flatnonzero(np.diff((codes != 32).view(np.int8)))
    starts, ends = edge[0::2] + 1, edge[1::2] + 1
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _UP[: len(codes)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))


def shingles(raw: bytes) -> np.ndarray:
    """The distinct shingles of a text, ascending; a shorter text is one shingle, a text without words none."""
    words = word_hashes(raw)
    if not len(words):
        return words
    n = min(WORDS, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        total += words[j : len(words) - n + 1 + j] * WEIGHTS[j]
    return np.unique(_mixed(total + np.uint64(n)))


_rng = np.random.default_rng(20210614)
_TIMES = _rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), REGISTERS) levels; every set must have an element."""
    out = np.empty((len(sets), REGISTERS), np.uint8)
    for i, s in enumerate(sets):
        least = np.full(REGISTERS, 2**32 - 1, np.uint32)
        low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
        for at in range(0, len(low), 2048):
            part = low[at : at + 2048]
            v = (part[:, None] ^ _XOR) * _TIMES
            v ^= v >> np.uint32(15)
            np.minimum(least, v.min(axis=0), out=least)
        out[i] = np.clip(np.floor(-LEVELS_AN_OCTAVE * np.log2((least + 1.0) / 2**32)), 0, 255)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


_GRID = np.linspace(0.0, 1.0, 101)


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sets of known sizes: the most likely value given which registers are above, below and equal."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u = size_a / (size_a + size_b)
    v = 1 - u

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = chance(u[:, None] - v[:, None] * _GRID), chance(v[:, None] - u[:, None] * _GRID)
    tiny = 1e-12
    log_l = above[:, None] * np.log(up + tiny) + below[:, None] * np.log(down + tiny) + equal[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return _GRID[log_l.argmax(axis=1)]
