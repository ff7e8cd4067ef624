"""Static binary-fuse filters (Graf and Lemire, 2022) over 64-bit keys, built and asked with numpy.

A filter is built once for a fixed set of keys and then only read. It never denies a key it was
built from; of other keys it lets about one in 65,536 pass.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

#: Fixed values of the 64-bit finaliser.
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class Fuse(NamedTuple):
    seed: int
    segment: int
    spread: int
    prints: np.ndarray


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64(seed)
    for factor in (MIX_1, MIX_2):
        x ^= x >> np.uint64(33)
        x = x * factor
    return x ^ (x >> np.uint64(33))


def _cells(h: np.ndarray, segment: int, spread: int) -> np.ndarray:
    """The three cells of each hash, in three consecutive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(spread) >> np.uint64(32)).astype(np.int64)
    mask = segment - 1
    second = (first + segment) ^ ((h >> np.uint64(18)).astype(np.int64) & mask)
    third = (first + 2 * segment) ^ (h.astype(np.int64) & mask)
    return np.stack([first, second, third])


def _print_of(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(37))).astype(np.uint16)


def _peeled(cells: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, own cells): each key is alone in its cell among the keys of its round and later ones. None if keys remain."""
    n = cells.shape[1]
    ids = np.arange(n, dtype=np.float64)
    left = np.bincount(cells.ravel(), minlength=size)
    total = sum(np.bincount(c, weights=ids, minlength=size) for c in cells)
    rounds, done = [], 0
    front = np.flatnonzero(left == 1)
    while len(front):
        keys, at = np.unique(total[front].astype(np.int64), return_index=True)
        rounds.append((keys, front[at]))
        done += len(keys)
        touched = cells[:, keys].ravel()
        np.subtract.at(left, touched, 1)
        np.subtract.at(total, touched, np.tile(keys.astype(np.float64), 3))
        touched = np.unique(touched)
        front = touched[left[touched] == 1]
    return rounds if done == n else None


def build(keys: np.ndarray) -> Fuse:
    """A filter of distinct uint64 keys."""
    n = len(keys)
    if n == 0:
        return Fuse(0, 1, 1, np.zeros(3, np.uint16))
    segment = 1 << min(18, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2))) * 1.02
    count = max(1, math.ceil(room / segment) - 2)
    spread = count * segment
    size = spread + 2 * segment
    for seed in range(1, 200):
        h = _mixed(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
        cells = _cells(h, segment, spread)
        if (rounds := _peeled(cells, size)) is None:
            continue
        prints = np.zeros(size, np.uint16)
        goal = _print_of(h)
        for own, cell in reversed(rounds):
            # The key's own cell still holds 0, so all three may be summed.
            prints[cell] = goal[own] ^ np.bitwise_xor.reduce(prints[cells[:, own]], axis=0)
        return Fuse(seed * 0x9E3779B97F4A7C15 % 2**64, segment, spread, prints)
    raise ValueError("no seed serves these keys; are they distinct?")


def contains(fuse: Fuse, keys: np.ndarray) -> np.ndarray:
    """For each key, whether it may be among those of the filter."""
    h = _mixed(keys, fuse.seed)
    cells = _cells(h, fuse.segment, fuse.spread)
    return np.bitwise_xor.reduce(fuse.prints[cells], axis=0) == _print_of(h)
