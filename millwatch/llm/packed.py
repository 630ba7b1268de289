"""Whole texts as byte buffers: words, hashes and rolling windows without a Python object per word.

Arrow hands a task its texts as one UTF-8 buffer with offsets.  Everything here is
numpy over such buffers, in chunks of about a megabyte, so that a task's memory does
not depend on how many rows a batch has.  A single text is never cut; it is the
least that a chunk can hold.

Hashes are 64-bit polynomials over bytes (words) or word hashes (windows), computed
from running sums modulo 2 ** 64 and mixed at the end.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 800_000

_M = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64
_M_INVERSE = np.uint64(pow(int(_M), -1, 2 ** 64))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def text_chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; NULL is empty."""
    column = batch.column(batch.schema.get_field_index(text))
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits, so that any bits of a hash can choose a bucket."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        done = 1
        while done < n:  # doubling: base ** (done + i) = base ** done * base ** i
            more = min(done, n - done)
            out[done:done + more] = out[:more] * (out[done - 1:done] * base)
            done += more
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start byte, end byte, 64-bit hash) of every run of non-blank bytes, in order."""
    blank = _BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = ~blank[edges]  # a word never crosses into the next text
    starts = np.flatnonzero(begins)
    ends_here = ~blank
    ends_here[:-1] &= blank[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    last = last[last < len(data)]
    ends_here[last] = ~blank[last]
    ends = np.flatnonzero(ends_here) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    sums = np.zeros(len(data) + 1, np.uint64)
    values = (LOWER[data] if lower else data).astype(np.uint64)
    values += np.uint64(1)
    values *= _powers(_M, len(data))
    np.cumsum(values, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_M_INVERSE, len(data) + 1)[starts] if len(starts) else np.zeros(0, np.uint64)
    return rows, starts, ends, mixed(hashes)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive values, by doubling; one entry per start."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, out, at, level, factor = 0, None, k, values, _M
    size = 1
    while at:
        if at & 1:
            piece = level[done:done + n]
            out = piece.copy() if out is None else out * factor + piece
            done += size
        at >>= 1
        if at:
            level = level[:len(level) - size] * factor + level[size:]
            size *= 2
            factor = np.uint64(int(factor) ** 2 % 2 ** 64)
    return mixed(out)


def window_rows(rows: np.ndarray, k: int) -> np.ndarray:
    """Which starts of ``rolling(values, k)`` lie in one text."""
    return rows[:len(rows) - k + 1] == rows[k - 1:] if len(rows) >= k else np.zeros(0, bool)


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie within ``length`` of some start."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, size), -1)
    return np.cumsum(edge[:size]) > 0


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ``known`` (sorted); a small table of low bits spares most of them the search."""
    out = np.zeros(len(values), bool)
    if len(known):
        low = np.zeros(1 << 16, bool)
        low[known & np.uint64(0xFFFF)] = True
        maybe = np.flatnonzero(low[values & np.uint64(0xFFFF)])
        some = values[maybe]
        out[maybe] = known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some
    return out
