"""Word scans over Arrow text columns: word limits, 64-bit word hashes and windows, without a Python step per word."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Texts are scanned in pieces of about this many bytes, which bounds a task's memory.
CHUNK_BYTES = 4 << 20
#: Bytes that are hashed at a time: some 25 bytes of arrays for each.
PIECE_BYTES = 256 << 10


def release() -> None:
    """Gives freed memory back to the system, so that a worker process waits for its next task with little. Called after each
    batch of work; where the C library has no such call, only Arrow's pool is emptied."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def released(work):
    """A function over batches that gives memory back at its end."""

    @functools.wraps(work)
    def run(batches):
        yield from work(batches)
        release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def weights(n: int, salt: int, begin: int = 0) -> np.ndarray:
    """n odd pseudo-random 64-bit weights from place `begin` on; those of a longer row are the same."""
    step = np.arange(begin + 1, begin + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(step + np.uint64(salt)) | np.uint64(1)


class Words(NamedTuple):
    data: np.ndarray  # the texts' bytes, end to end
    first: np.ndarray  # of each word, its first byte
    last: np.ndarray  # and the byte after it
    hash: np.ndarray
    count: np.ndarray  # of each text, its number of words
    at: np.ndarray  # and its first word


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches whose texts have about `most` bytes (one text alone may have more)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)


def scan(texts: pa.Array, lower: bool, salt: int = 0) -> Words:
    """All words `[^\\x20\\x09-\\x0D]+` of the texts (null: none). lower: A-Z count as a-z."""
    data, offsets = _bytes(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none, zero = np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        return Words(data, none, none, none.astype(np.uint64), zero, zero)
    sep = _SEP[data]
    begins = ~sep
    begins[1:] &= sep[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    begins[starts] = ~sep[starts]
    first = np.flatnonzero(begins)
    ends = ~sep
    ends[:-1] &= sep[1:] | begins[1:]
    last = np.flatnonzero(ends) + 1
    count = np.searchsorted(first, offsets[1:]) - np.searchsorted(first, offsets[:-1])
    at = np.cumsum(count) - count
    return Words(data, first, last, _hash(data, first, last, salt), count, at)


def _hash(data: np.ndarray, first: np.ndarray, last: np.ndarray, salt: int) -> np.ndarray:
    """Of each word, the sum of its bytes times a weight for their place, and its length, mixed. Words are read PIECE_BYTES
    at a time, and a longer word in pieces, so that the arrays of one value a byte stay small."""
    n = len(first)
    if not n:
        return np.zeros(0, np.uint64)
    size = last - first
    ends = np.cumsum(size)
    total = np.zeros(n, np.uint64)
    table = weights(int(min(size.max(), PIECE_BYTES)), salt)
    lo = 0
    while lo < n:
        begin = int(ends[lo] - size[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, begin + PIECE_BYTES, side="right")))
        if hi == lo + 1 and size[lo] > PIECE_BYTES:
            for at in range(0, int(size[lo]), PIECE_BYTES):
                part = data[first[lo] + at : min(first[lo] + at + PIECE_BYTES, last[lo])].astype(np.uint64) + np.uint64(1)
                total[lo : lo + 1] += (part * weights(len(part), salt, at)).sum()
        else:
            sizes, before = size[lo:hi], ends[lo:hi] - size[lo:hi] - begin
            inside = np.arange(int(ends[hi - 1]) - begin, dtype=np.int64) - np.repeat(before, sizes)
            value = table[inside]
            inside += np.repeat(first[lo:hi], sizes)
            value *= data[inside].astype(np.uint64) + np.uint64(1)
            total[lo:hi] = np.add.reduceat(value, before)
        lo = hi
    total += size.astype(np.uint64)
    return mix(total)


def windows(words: Words, k: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of each run of k words of one text; word: the place of its first among all words."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = weights(k, salt)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += words.hash[j : n - k + 1 + j] * w[j]
    end = np.repeat(words.at + words.count, words.count)[: n - k + 1]
    whole = np.arange(k, n + 1) <= end
    return mix(total[whole]), np.flatnonzero(whole)
