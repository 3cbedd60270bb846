"""Words of many texts as arrays: places in the UTF-8 bytes, 64-bit keys, and keys of word windows."""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLES: dict[int, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    had = _TABLES.get(base)
    if had is None or len(had) < n:
        made = np.full(max(n, 1 << 16), base, np.uint64)
        made[0] = 1
        _TABLES[base] = had = np.cumprod(made)
    return had[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end in data of the words ``[^\\x20\\x09-\\x0D]+``."""
    gap = np.concatenate([[True], _SPACE[np.frombuffer(data, np.uint8)], [True]])
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def keys(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A key of each word's bytes, the same wherever the word stands."""
    if not len(start):
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * powers(BASES[0], len(raw)))])
    return mix((total[end] - total[start]) * powers(inverse(BASES[0]), len(raw))[start])


def windows(word_keys: np.ndarray, k: int, base: int = BASES[1]) -> np.ndarray:
    """Keys of all windows of k words that start at words 0 .. n-k."""
    n = len(word_keys)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_keys * powers(base, n))])
    return mix((total[k:] - total[: n - k + 1]) * powers(inverse(base), n)[: n - k + 1])
