"""Words of many texts at once, as numpy arrays over their UTF-8 bytes: spans and 64-bit hashes without a Python object per word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    return up, down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def joined(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a line feed, and where each text starts. Lower-casing is of A-Z only."""
    data = [t.encode() for t in texts]
    whole = b"\n".join(data) + b"\n"
    sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
    return np.frombuffer(whole.lower() if lower else whole, np.uint8), np.cumsum(sizes) - sizes


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.append(0, edge)
    if len(edge) % 2:
        edge = np.append(edge, len(inside))
    return edge[::2], edge[1::2]


def hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:stop] for each span, from one running sum."""
    up, down = _powers(1 << max(16, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values (len - k + 1 of them, none if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x100000001B3) + h[j : j + n]
    return mixed(out)


#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z: digits, a-z and every byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True
