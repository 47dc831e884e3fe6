"""Vectorised text kernels over Arrow buffers: words, their hashes and n-word shingles of many rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: bytes of text that one block of rows holds; a longer row makes a block of its own
BLOCK_BYTES = 1 << 20

_rng = np.random.default_rng(20240517)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_STEP = U64(0x9E3779B97F4A7C15 | 1)
_FOLD = U64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: everything but ASCII letters, digits and the bytes of non-ASCII characters
_NOT_TERM = np.ones(256, bool)
_NOT_TERM[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _NOT_TERM[_a:_b] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


_POWERS = _powers(4096)


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of at most ``limit`` bytes; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_hashes(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, first word of each row with the total at the end)."""
    n = len(offsets) - 1
    inside = ~gaps[data]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) > 1
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    new |= edge[at]
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    powers = _POWERS if length.max() <= len(_POWERS) else _powers(int(length.max()))
    chars = data[at]
    h = np.add.reduceat(_BYTE[_LOWER[chars] if lower else chars] * powers[place], first)
    rows = np.searchsorted(at[first], offsets)
    return mix(h + length.astype(np.uint64) * _FOLD), rows


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, for terms: runs of letters, digits and non-ASCII characters, A-Z lowered."""
    return word_hashes(data, offsets, _NOT_TERM)


def shingles(h: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each window of ``width`` words; a row with fewer words is one shingle, without words none."""
    n = len(rows) - 1
    count = np.diff(rows)
    row_of = np.repeat(np.arange(n), count)
    out, where = [], []
    for w in range(1, width + 1):
        if w < width:
            start = rows[:-1][count == w]
        else:
            i = np.arange(len(h))
            start = i[i + width <= rows[1:][row_of]]
        if not len(start):
            continue
        g = h[start]
        for j in range(1, w):
            g = mix(g) * _FOLD + h[start + j]
        out.append(mix(g + U64(w)))
        where.append(row_of[start])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g, r = np.concatenate(out), np.concatenate(where)
    if len(out) > 1:
        order = np.argsort(r, kind="stable")
        g, r = g[order], r[order]
    return g, r


def distinct(g: np.ndarray, r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each row in ascending order: (hashes, their counts in the row, first index of each row and the end)."""
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(g)))
    return g[first], times, np.searchsorted(r[first], np.arange(n + 1))


def row_reduce(f: np.ufunc, values: np.ndarray, rows: np.ndarray, empty) -> np.ndarray:
    """f over the values of each row; ``empty`` for rows without any."""
    full = np.diff(rows) > 0
    out = np.full((len(rows) - 1, *values.shape[1:]), empty, values.dtype)
    if full.any():
        out[full] = f.reduceat(values, rows[:-1][full], axis=0)
    return out


def binary(rows: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the bytes of values[rows[i]:rows[i+1]]."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(rows, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])
