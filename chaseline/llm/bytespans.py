"""Vectorised work on the UTF-8 bytes of an Arrow text column.

Every helper works on slices of a few megabytes, so that a Python worker's
memory does not depend on how many rows an Arrow batch holds. A slice is
``(first_row, next_row, buf, off)``: ``buf`` is a private uint8 copy with 8
spare zero bytes at its end, ``off`` the byte offsets of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_SPARE = 8
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of about ``limit`` bytes; a null is an empty text; a longer text is a slice of its own."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        buf = np.zeros(off[j] - off[i] + _SPARE, dtype=np.uint8)
        buf[:-_SPARE] = data[off[i] : off[j]]
        yield i, j, buf, off[i : j + 1] - off[i]
        i = j


def lower_ascii(buf: np.ndarray) -> None:
    """Lower-cases A-Z in place."""
    buf[(buf >= 65) & (buf <= 90)] += 32


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``; a run never crosses from one row into the next."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes a step."""
    words = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    left = ends - starts
    out = mix(left.astype(np.uint64) + _K1)
    at, live = starts, np.arange(len(starts))
    while len(live):
        out[live] = mix((out[live] ^ (words[at] & _MASKS[np.minimum(left, 8)])) * _K1 + _K3)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span's content, a span of each number). Spans of one hash are compared byte by byte, eight bytes a step.

    Should two contents have one hash, every span gets a number of its own.
    """
    codes, _ = pd.factorize(span_hashes(buf, starts, ends))
    first = np.zeros(int(codes.max(initial=-1)) + 1, dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    words = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    left, at, other = ends - starts, starts, starts[first][codes]
    same = bool((left == (ends - starts)[first][codes]).all())
    while same and len(at):
        same = not ((words[at] ^ words[other]) & _MASKS[np.minimum(left, 8)]).any()
        more = left > 8
        left, at, other = left[more] - 8, at[more] + 8, other[more] + 8
    return (codes, first) if same else (np.arange(len(starts)), np.arange(len(starts)))
