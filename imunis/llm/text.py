"""Vectorised words and rolling (Karp-Rabin) hashes over Arrow string columns.

A column's bytes are worked on in place, in pieces of about a megabyte, so
memory does not depend on a text's length. Hashes are 64-bit polynomials over
random values for each byte, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240607).integers(1, 1 << 64, 256, np.uint64, endpoint=False)
#: A-Z share the values of a-z.
FOLDED = _RANDOM.copy()
FOLDED[65:91] = FOLDED[97:123]

_ASCII = np.arange(256)
#: Words end at these bytes (white space; or all that is neither letter nor digit nor above ASCII).
WHITE = (_ASCII == 32) | ((_ASCII >= 9) & (_ASCII <= 13))
PUNCT = (_ASCII < 128) & ~(((_ASCII >= 48) & (_ASCII < 58)) | ((_ASCII >= 65) & (_ASCII < 91)) | ((_ASCII >= 97) & (_ASCII < 123)))

_tables: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    table = _tables.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, PIECE + 64), base, np.uint64)
        table[0] = 1
        table = np.cumprod(table)
        if n <= 4 * PIECE:
            _tables[base] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash's bits (an invertible step)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` values (uint64), by prefix sums."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=total[1:])
    return mix((total[width:] - total[:n]) * powers(n, _INVERSE))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null rows are empty."""
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, bounds: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut between rows, or behind a word end inside a long row."""
    at, n = 0, len(data)
    while at < n:
        if n - at <= PIECE:
            to = n
        else:
            to = int(bounds[np.searchsorted(bounds, at + PIECE, "right") - 1])
            if to <= at:
                to = at + PIECE
                stop = int(bounds[np.searchsorted(bounds, at, "right")])
                while to < stop:
                    gap = np.flatnonzero(ends[data[to:min(stop, to + PIECE)]])
                    if len(gap):
                        to += int(gap[0]) + 1
                        break
                    to = min(stop, to + PIECE)
        yield at, to
        at = to


def words(data: np.ndarray, bounds: np.ndarray, ends: np.ndarray = WHITE, latin: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each row the index of its first word (n + 1 values).

    Words are runs of bytes that are not in ``ends``, never across rows, with
    A-Z lower-cased and, if ``latin``, the capitals of Latin-1 as well.
    """
    hashes, starts = [], []
    for lo, hi in _pieces(data, bounds, ends):
        piece = data[lo:hi]
        if latin:
            accent = np.zeros(len(piece), bool)
            accent[1:] = (piece[:-1] == 0xC3) & (piece[1:] >= 0x80) & (piece[1:] <= 0x9E) & (piece[1:] != 0x97)
            piece = np.where(accent, piece | 0x20, piece)
        inside = ~ends[piece]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = bounds[np.searchsorted(bounds, lo, "right"):np.searchsorted(bounds, hi, "left")] - lo
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(FOLDED[piece] * powers(len(piece)), out=total[1:])
        hashes.append(mix((total[end] - total[start]) * powers(len(piece), _INVERSE)[start] + (end - start).astype(np.uint64)))
        starts.append(start + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row, its distinct shingles of ``width`` words, sorted; fewer words make one shingle, none make none."""
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for j in range(width):
        rolled += hashes[j:j + len(rolled)] * powers(width + 1)[j + 1]
    rolled = mix(rolled)
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - s >= width:
            yield np.unique(rolled[s:e - width + 1])
        elif e > s:
            yield mix((hashes[s:e] * powers(e - s + 1)[1:]).sum(keepdims=True) + np.uint64(e - s))
        else:
            yield np.zeros(0, np.uint64)
