"""Words and word n-grams of a whole Arrow string array at once, as 64-bit hashes (NumPy over the UTF-8 bytes).

A word's hash is a sum of one random 64-bit value for each of its bytes and places (tabulation hashing), then mixed: two
different words are equal with a chance of 2^-64 whatever their letters, so no family of texts collides by
construction, as it would under a polynomial. An n-gram's hash mixes its words' hashes pairwise, in order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Text handled at once: keeps the temporary arrays, up to 8 bytes for each byte of text, small.
CHUNK_BYTES = 1 << 19
#: Places of a word whose values are tabulated; values of later places are computed.
_PLACES = 32


def byte_table(separators: bytes, lower: bool = False) -> np.ndarray:
    """For each byte the value that is hashed; 0 marks a separator."""
    t = np.arange(256, dtype=np.uint16) + np.uint16(1)
    if lower:
        t[65:91] += np.uint16(32)
    t[list(separators)] = 0
    return t


#: Words [^\x20\x09-\x0D]+, unchanged and with A-Z lower-cased.
SPACED = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
SPACED_LOWER = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d", lower=True)
_OTHER = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased.
ALNUM_LOWER = byte_table(_OTHER, lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def _value(code: np.ndarray) -> np.ndarray:
    """The random value of a byte and place: code is place * 257 + byte value."""
    return mix(mix(code.astype(np.uint64) * _LEFT + _RIGHT))


@cache
def _values() -> np.ndarray:
    """_value by code for the first places, 0 for separators."""
    out = _value(np.arange(_PLACES * 257))
    out[::257] = 0
    return out


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Running sums of the bytes' values, each by its place in its word."""
    n = len(values)
    place = np.ones(n, np.int32)
    # each word's first byte goes back to place 0, whatever the count was before it
    place[starts[:1]] = 0
    place[starts[1:]] = (starts[:-1] - starts[1:] + 1).astype(np.int32)
    place[: starts[0]] = 0
    np.cumsum(place, out=place)
    long = np.flatnonzero(ends - starts > _PLACES)
    if len(long):
        far = np.concatenate([np.arange(starts[i] + _PLACES, ends[i]) for i in long])
        code = place[far].astype(np.int64) * 257 + values[far]
    np.minimum(place, _PLACES - 1, out=place)
    place *= 257
    place += values
    r = np.take(_values(), place, mode="clip")
    if len(long):
        r[far] = _value(code)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(r, out=total[1:])
    return total


def _combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _LEFT + b * _RIGHT)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def karp_rabin(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling hash of values[start:end] for each range, the same wherever it stands. It only proposes: whoever uses
    it compares the values themselves."""
    p, inv = (x[: len(values)] for x in _powers(1 << max(12, len(values).bit_length())))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * p, dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * _M2)


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    a = col if pa.types.is_large_string(col.type) else col.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    bufs = a.buffers()
    off = np.frombuffer(bufs[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(col: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of up to `most` bytes, one row at least."""
    _, off = string_parts(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(col: pa.Array, table: np.ndarray, heads: tuple[int, ...] = ()):
    """(hash, row, start, end) of each word in order; starts and ends are byte positions in the array's bytes. With
    heads, hash has a column for the word and one for the first k bytes of it for each k."""
    raw, off = string_parts(col)
    n = len(raw)
    if not n:
        e = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(heads)) if heads else 0, np.uint64), e, e, e
    v = table[raw]
    is_word = v > 0
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], is_word[:-1]])
    after = np.concatenate([is_word[1:], [False]])
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    rows = np.searchsorted(off, starts, "right") - 1
    total = _sums(v, starts, ends) if len(starts) else v
    of = lambda ends: mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64) * _M2)
    h = np.stack([of(ends), *(of(np.minimum(ends, starts + k)) + np.uint64(k) for k in heads)], 1) if heads else of(ends)
    return h, rows, starts, ends


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries, whatever rows they are in: runs of 1, 2, 4, ... are combined pairwise."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, width, run, left = None, 0, 1, h, k
    while True:
        if left & 1:
            part = run[at : at + n]
            out = part if out is None else _combine(out, part)
            at += width
        left >>= 1
        if not left:
            return mix(out + np.uint64(k))
        run = _combine(run[:-width], run[width:])
        width *= 2


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w consecutive entries."""
    out, width = a, 1
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(a) - w + 1], out[w - width :]) if w > width else out


def count_words(col: pa.Array, table: np.ndarray) -> np.ndarray:
    """Number of words of each row."""
    _, rows, _, _ = words(col, table)
    return np.bincount(rows, minlength=len(col))
