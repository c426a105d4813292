"""Vectorised text helpers for code that runs inside tasks (numpy over Arrow buffers).

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; all hashes are
64-bit polynomial hashes over a fixed random byte table, so equal byte strings
always hash alike, whatever their place in a buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
SEGMENT_BYTES = 1 << 20
_POW: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POW.get(name)
    if have is None or len(have) < n:
        n = max(n, SEGMENT_BYTES + (1 << 16))
        out = np.empty(n, dtype=np.uint64)
        out[0] = 1
        size = 1
        while size < n:
            step = U64(pow(base, size, 1 << 64))
            take = min(size, n - size)
            np.multiply(out[:take], step, out=out[size:size + take])
            size += take
        _POW[name] = have = out
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = hash of buf[i:j] times base^i."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[buf] * _powers("up", _BASE, len(buf))[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each buf[start:end], independent of where it stands."""
    inv = _powers("down", _BASE_INV, len(prefix))
    raw = (prefix[ends] - prefix[starts]) * inv[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0]: off[-1]], off - off[0]


def segments(offsets: np.ndarray, limit: int = SEGMENT_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (a longer row stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (n_rows + 1 values)."""
    word = ~IS_SPACE[buf]
    first, last = word.copy(), word.copy()
    if len(buf):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        at = offsets[offsets < len(buf)]
        first[at] = word[at]                       # a word never crosses rows
        at = offsets[offsets > 0] - 1
        last[at] = word[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each row) for successive row ranges of bounded size.

    A row longer than the bound is hashed in slices cut at white space.
    """
    buf, off = text_buffer(column)
    for i, j in segments(off):
        part, rel = buf[off[i]: off[j]], off[i: j + 1] - off[i]
        if lower:
            part = LOWER[part]
        starts, ends, row = word_spans(part, rel)
        if len(part) <= 2 * SEGMENT_BYTES:
            yield i, span_hash(prefix_hash(part), starts, ends), row
            continue
        out, k = np.empty(len(starts), np.uint64), 0
        while k < len(starts):
            m = max(k + 1, int(np.searchsorted(ends, starts[k] + SEGMENT_BYTES, side="right")))
            base = starts[k]
            out[k:m] = span_hash(prefix_hash(part[base: ends[m - 1]]), starts[k:m] - base, ends[k:m] - base)
            k = m
        yield i, out, row


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; of the whole sequence when it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = mix(h * U64(0x9FB21C651E98DF25) + words[i: n - k + 1 + i])
    return h
