"""Hashed tokens for the models that read texts."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

CACHED_WORDS = 200_000  # words whose features a task remembers; it forgets them all when full


def cached(feature: Callable[[bytes], tuple]) -> Callable[[list[bytes]], list[tuple]]:
    """``feature`` over the words of a text, computed once for a word as long as it's remembered."""
    known: dict[bytes, tuple] = {}

    def all_of(words: list[bytes]) -> list[tuple]:
        out = []
        for w in words:
            f = known.get(w)
            if f is None:
                if len(known) >= CACHED_WORDS:
                    known.clear()
                f = known[w] = feature(w)
            out.append(f)
        return out

    return all_of


def slot(data: bytes, bits: int) -> int:
    """A stable hash slot: two CRCs, so that short strings spread well."""
    return (zlib.crc32(data) ^ (zlib.crc32(b"\x01" + data) << 7)) & ((1 << bits) - 1)


def mix(*ids: np.ndarray, bits: int) -> np.ndarray:
    """Slots of n-grams from the slots of their parts; order matters."""
    x = np.zeros(len(ids[0]), dtype=np.uint64)
    for part in ids:
        x = (x ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x & np.uint64((1 << bits) - 1)).astype(np.int64)
