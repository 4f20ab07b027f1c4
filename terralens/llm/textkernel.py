"""Vectorised text kernels over Arrow string buffers.

Texts of a batch are handled as one byte array with document offsets. Work is cut into slices of
about ``SLICE_BYTES`` of text (one longer document makes a slice of its own), so the memory of a
Python worker is bounded by the slice, not by the Arrow batch. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
_rng = np.random.RandomState(20240229)
#: A random odd 64-bit value for each byte, for n-gram features.
BYTE_CODE = (_rng.randint(0, 1 << 32, 256).astype(U64) << U64(32)) | _rng.randint(0, 1 << 32, 256).astype(U64) | U64(1)
#: Span hashes are polynomials over the prime field of 2**61 - 1: two different spans of n bytes meet with probability n / 2**61, however regular they are.
#: (Modulo a power of two, regular texts such as Thue-Morse words meet for certain.)
PRIME = (1 << 61) - 1
_P = U64(PRIME)
_BASE = 0x1B5A7F3C94E6D281
_BASE_INV = pow(_BASE, -1, PRIME)
_LOW31 = U64((1 << 31) - 1)
#: Bytes hashed at once: their arrays stay in the processor's cache, and sums of so many terms below 2**40 fit in 64 bits.
_BLOCK = 1 << 15
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of ``[^\x20\x09-\x0D]+``: non-ASCII characters consist of bytes from 0x80 on.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any 64-bit x."""
    x = (x & _P) + (x >> U64(61))
    np.subtract(x, _P, out=x, where=x >= _P)
    return x


def _times_2_31(x: np.ndarray) -> np.ndarray:
    """x * 2**31 modulo the prime, x being reduced: a rotation of 61 bits."""
    return ((x << U64(31)) & _P) | (x >> U64(30))


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, both reduced."""
    a1, a0, b1, b0 = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    # a1 b1 2**62 + (a1 b0 + a0 b1) 2**31 + a0 b0, with 2**61 = 1
    middle = _reduce(a1 * b0 + a0 * b1)
    return _reduce(_reduce(a1 * b1 * U64(2)) + _times_2_31(middle) + _reduce(a0 * b0))


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo the prime for i < n; kept for slices of usual size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have, step = np.ones(1, U64), base
        while len(have) < max(n, SLICE_BYTES + 4096):
            have = np.concatenate([have, multiply(have, np.array([step], U64))])
            step = step * step % PRIME
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string or binary array."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each slice of a column."""
    data, off = buffers(col)
    for i, j in slices(off, limit):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] the sum of (byte + 1) * base**place over the first i bytes, modulo the prime; see span_hash."""
    out = np.zeros(len(data) + 1, U64)
    power = powers(_BASE, len(data))
    for k in range(0, len(data), _BLOCK):
        code, p = data[k : k + _BLOCK].astype(U64) + U64(1), power[k : k + _BLOCK]
        high, low = np.cumsum(code * (p >> U64(31))), np.cumsum(code * (p & _LOW31))
        out[k + 1 : k + 1 + len(code)] = _reduce(_times_2_31(_reduce(high)) + _reduce(low) + out[k])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, whatever its place."""
    return mix(multiply(_reduce(prefix[end] + _P - prefix[start]), powers(_BASE_INV, len(prefix))[start]))


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document (and the end) the index of its first word."""
    n = len(data)
    inside = is_word[data]
    first = inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        at = off[:-1][off[:-1] < n]
        first[at] = inside[at]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        at = off[1:] - 1
        at = at[at >= 0]
        last[at] = inside[at]
    else:
        last = first
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and each document's first word."""
    starts, ends, at = words(data, off, is_word)
    return span_hash(prefix_hash(data), starts, ends), at


def segment_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]]; empty segments give 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def char_starts(data: np.ndarray) -> np.ndarray:
    """True where a code point begins."""
    return (data & 0xC0) != 0x80


def code_points(data: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
