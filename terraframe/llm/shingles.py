"""Hashes of a text's word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash


def hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, with repeats, some at a time; of a shorter text as a whole; of no words nothing."""
    words = text.lower().split()  # A-Z only; white space is 0x20 and 0x09-0x0D
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= shingle:
        yield np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
        return
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        yield np.array([digest(joined[s:e], 42) for s, e in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist())], np.uint64)
