"""Words of whole batches of texts as numbers, without a Python object per word."""

from __future__ import annotations

import numpy as np


def byte_table(word: bytes, lower: bool = True) -> bytes:
    """Translation of bytes: those in ``word`` stay (A-Z lower-cased), every other becomes a space."""
    keep = set(word)
    return bytes((b + 32 if lower and 65 <= b <= 90 else b) if b in keep else 32 for b in range(256))


#: Letters and digits of ASCII, and every byte of a longer code point.
TERMS = byte_table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))


def coded(texts: list[bytes], table: bytes = TERMS):
    """(code of every word, the words by code, how many words lie before each text with the total last)."""
    import pyarrow as pa

    data = np.frombuffer(b"\n".join([*texts, b""]).translate(table), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside[1:-1]])]).dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary, before
