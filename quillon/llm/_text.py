"""Words, word hashes and shingles of UTF-8 text, computed on whole Arrow buffers.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; A-Z are lower-cased. Hashes have 64 bits. They take
eight bytes at a time, each through a bijection that is not linear, so that no regular texts have equal hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in runs of about so many bytes, so that a task's memory does not follow the size of its batches.
RUN_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
#: Longer pieces of text are hashed by BLAKE2b.
_SHORT = 64


def block(padded: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first size bytes, eight at most, from each place on as little-endian integers. padded has eight spare bytes."""
    view = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    return view[at] & _LOW_BYTES[np.minimum(size, 8)]


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate((data, np.zeros(8, np.uint8)))


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes between starts and ends."""
    whole, size = padded(data), ends - starts
    out = mix(size.astype(np.uint64))
    rest = np.arange(len(starts))
    for k in range(0, _SHORT, 8):
        rest = rest[size[rest] > k] if k else rest
        if not len(rest):
            break
        out[rest] = mix((out[rest] + _U(k)) ^ block(whole, starts[rest] + k, size[rest] - k))
    for k in np.flatnonzero(size > _SHORT).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer row stands alone and whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Code points of scripts without blanks between words, and full-width and CJK punctuation: first and last of each range.
_UNSPACED = [(0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3040, 0x30FA), (0x30FC, 0x312F), (0x3190, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)]
_WIDE_MARKS = [(0x3000, 0x3004), (0x3008, 0x3020), (0x302A, 0x3030), (0x3036, 0x303F), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]


def _within(points: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    bounds = np.array(ranges).ravel() + np.tile([0, 1], len(ranges))
    return np.searchsorted(bounds, points, "right") % 2 == 1


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of characters that are words, their ends, bytes of wide punctuation) of valid UTF-8."""
    at = np.flatnonzero(data >= 0xE0)
    if not len(at):
        return at, at, at
    four = data[at] >= 0xF0
    b = [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F for k in range(4)]
    three = (b[0] & 0x0F) << 12 | b[1] << 6 | b[2]
    points = np.where(four, (b[0] & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3], three)
    alone, marks = _within(points, _UNSPACED), at[_within(points, _WIDE_MARKS)]
    return at[alone], at[alone] + 3 + four[alone], (marks[:, None] + np.arange(3)).ravel()


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE, accents: bool = False, unspaced: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, bounds): byte positions and hashes of all words; row i has words bounds[i]:bounds[i+1].

    between: which bytes stand between words. accents: the capitals of Latin-1 hash like their small letters, too.
    unspaced: characters of scripts without blanks are words, and wide punctuation stands between words.
    """
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    ink = ~between[data]
    if accents:
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data = data.copy()
        data[capital] += 32
    first, last = ink.copy(), ink.copy()
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if unspaced:
        begin, end, marks = _characters(data)
        cut[begin] = cut[end] = True
        ink[marks] = first[marks] = last[marks] = False
    first[1:] &= ~ink[:-1] | cut[1:n]
    last[:-1] &= ~ink[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, hashes_of(_LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of size words; with fewer words, of the whole sequence; of no words, none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(size, n)
    out = np.full(n - k + 1, _U(k))
    for j in range(k):
        out = mix((out + _U(j)) ^ hashes[j : n - k + 1 + j])
    return out
