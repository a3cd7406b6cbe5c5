"""Vectorised word splitting and window fingerprints over the UTF-8 bytes of many texts.

All functions take one contiguous byte buffer with the texts' offsets, as Arrow
stores a string column, and work on whole texts. Words have keys that mix their
bytes in one after another. Fingerprints of windows are polynomial hashes
modulo 2**64 over such keys or random letter codes: a prefix sum gives the code
of any range, so every window of every text costs the same few array operations.
These are for windows of up to a few hundred places; long sequences can be built
whose polynomials agree, so whole texts and words have digests instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 512 << 10
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_CODES = np.random.default_rng(20240229).integers(1, 2**63, (2, 256), dtype=np.uint64) * 2 + 1
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SEEDS = np.array([0x8A5CD789635D2DFF, 0x121FD2155C472F96], dtype=np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
_ALL = np.uint64(2**64 - 1)
#: Bytes of a word beyond which the rest is digested at once.
LONG_WORD = 1024
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of a base and of its inverse modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 19)
        base = _BASES[which]
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        have = _POWERS[which] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit key over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, bytes, offsets), about ``chunk_bytes`` each.

    A null is an empty text. A text longer than a run is a run of its own, so no
    text is ever cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64, count=column.offset + n + 1)[column.offset:]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + chunk_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word (one more at the end).

    ``between`` marks the bytes that part words, white space unless told otherwise.
    """
    n = len(data)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    space = between[data]
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    edge[1:] = space[:-1]
    inner = offsets[1:-1]
    edge[inner[inner < n]] = True
    starts = np.flatnonzero(edge & ~space)
    close = np.empty(n, dtype=bool)
    close[-1] = True
    close[:-1] = space[1:]
    close[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(close & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def range_codes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Fingerprint of every range ``codes[start:end]``; equal ranges have equal fingerprints."""
    p, inverse = _powers(which, len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * p[:len(codes)], out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts])


def byte_codes(data: np.ndarray, which: int = 0, lower: bool = False) -> np.ndarray:
    table = _CODES[which]
    return (table[_LOWER] if lower else table)[data]


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, lower: bool = False) -> np.ndarray:
    """One 64-bit key per word: its bytes, eight at a time, each mixed in before the next."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:len(data)] = _LOWER[data] if lower else data
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    keys = mixed((ends - starts).astype(np.uint64) ^ _SEEDS[which])
    left = np.arange(len(starts))
    at = starts
    while len(left):
        kept = np.minimum(ends[left] - at, 8).astype(np.uint64)
        part = eights[at] & (_ALL >> (np.uint64(64) - np.uint64(8) * kept))
        keys[left] = mixed(keys[left] ^ part * _ODD[which]) * _ODD[which]
        more = ends[left] - at > 8
        left, at = left[more], at[more] + 8
        if len(left) and at[0] - starts[left[0]] >= LONG_WORD:
            for i, rest in zip(left.tolist(), at.tolist()):
                keys[i] ^= np.frombuffer(hashlib.blake2b(padded[rest:ends[i]], digest_size=8, salt=bytes([which])).digest(), dtype="<u8")[0]
            break
    return keys


def sequence_codes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of the whole word sequences of texts, in two halves."""
    raw = b"".join(hashlib.blake2b(words[a:b], digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:]))
    both = np.frombuffer(raw, dtype="<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count c, joined."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(before, counts)
