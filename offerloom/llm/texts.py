"""Whole texts as byte arrays inside tasks: words, their places and 64-bit hashes, computed by numpy over Arrow buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text is a piece of its own, cut again inside.
PIECE = 1 << 19

U64 = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_MULTIPLIER = 0x9E3779B97F4A7C15
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_TABLES.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
                x = np.full(n, base, U64)
                x[0] = 1
                _TABLES[name] = np.multiply.accumulate(x)
    return _TABLES["up"][:n], _TABLES["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random-looking number for each byte.
BYTE_VALUE = mixed(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95 >> 1))


def byte_class(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Lower-cases A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
#: After folding: ASCII digits and letters, and every byte of a character beyond ASCII.
ALNUM = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: Everything but ASCII white space.
VISIBLE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def trimmed() -> None:
    """Give freed memory back: Python workers stay when their task ends, beside those of the next stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def pieces(batch: pa.RecordBatch, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose first column (texts) holds about `most` bytes, one row at least."""
    if not batch.num_rows:
        return
    bounds = raw(batch.column(0))[1]
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
    trimmed()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows in them, from 0; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(bounds) else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words (maximal runs of bytes of a class, after FOLD) of the rows; none crosses a row."""
    n, at, out = len(data), 0, []
    while at < n:
        end = min(at + PIECE, n)
        if end < n:  # cut after a separator, or else at the next one or the next row
            gap = np.flatnonzero(~inside[FOLD[data[at:end]]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:
                row = int(bounds[np.searchsorted(bounds, end)])
                gap = np.flatnonzero(~inside[FOLD[data[end:row]]])
                end += int(gap[0]) if len(gap) else row - end
        piece = FOLD[data[at:end]]
        is_word = inside[piece]
        firsts = bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, end, "left")] - at
        before = np.empty_like(is_word)
        before[0], before[1:] = False, is_word[:-1]
        before[firsts] = False
        after = np.empty_like(is_word)
        after[-1], after[:-1] = False, is_word[1:]
        after[firsts - 1] = False
        s, e = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
        up, down = _powers(len(piece))
        sums = np.zeros(len(piece) + 1, U64)
        np.cumsum(BYTE_VALUE[piece] * up, out=sums[1:])
        out.append((s + at, e + at, mixed((sums[e] - sums[s]) * down[s])))
        at = end
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries, for each first place of such a run."""
    count = max(0, len(hashes) - n + 1)
    total = np.zeros(count, U64)
    for j in range(n):
        total = total * U64(_MULTIPLIER) + hashes[j : j + count]
    return mixed(total)

