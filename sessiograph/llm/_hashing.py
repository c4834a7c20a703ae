"""Polynomial hashes over byte arrays, for whole batches of texts at once."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

#: An odd multiplier modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Strings up to this length are told apart by a polynomial modulo 2**64; regular strings of 1024 bytes can agree in it whatever the base.
PLAIN = 256


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i up to n."""
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``powers`` for at least n, with few different sizes."""
    return powers(1 << max(16, int(n).bit_length()))


def prefix(data: np.ndarray) -> np.ndarray:
    """Running sum of (byte + 1) * B**i with a leading zero: the hash of [s, e) is (p[e] - p[s]) * B**-s."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * tables(len(data))[0][: len(data)], out=out[1:])
    return out


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end), equal for equal bytes wherever they stand."""
    return mix((p[end] - p[start]) * tables(len(p))[1][start])


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [start, end); the few longer than PLAIN bytes by a cryptographic hash."""
    out = spans(prefix(data), start, end)
    for i in np.flatnonzero(end - start > PLAIN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts one behind the other, and where each starts (with the end last)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer(b"".join(texts), np.uint8), at


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``joined`` texts, and how many words lie before each text (with the total last)."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[:-1][at[:-1] < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = cuts[cuts > 0] - 1
    last[ends] = inside[ends]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)
