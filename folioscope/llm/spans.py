"""Runs of bytes in whole Arrow columns of text, found and hashed by array operations: no Python object per word."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .base import mixed

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2^64
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each row begins and the last ends; a null row has none."""
    a = pc.fill_null(col.cast(pa.large_binary()), b"")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def portions(batches: Iterable[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about `most` bytes of the column text; a longer text is a run of its own."""
    for b in batches:
        end = np.cumsum(pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


def spans(inside: np.ndarray, rows: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `inside`; none crosses a row's start or a True of `cuts` (a cut before that byte)."""
    n = len(inside)
    begins = np.ones(n + 1, bool)
    if n:
        begins[1:n] = ~inside[:-1] if cuts is None else ~inside[:-1] | cuts[1:]
        begins[rows] = True
    return np.flatnonzero(inside & begins[:n]), np.flatnonzero(inside & (begins[1:] | ~np.append(inside[1:], False)[:n])) + 1


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _STEP, np.uint64)
    down = np.full(n, pow(_STEP, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, slice_bytes: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the spans' bytes, by differences of a running polynomial sum over slices of whole spans."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + slice_bytes, "right")))
        size = int(ends[j - 1]) - base
        up, down = _powers(1 << max(size, slice_bytes).bit_length())
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[raw[base : base + size]] * up[:size], out=total[1:])
        out[i:j] = (total[ends[i:j] - base] - total[starts[i:j] - base]) * down[starts[i:j] - base]
        i = j
    return mixed(out)


def gathered(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ragged slices [offset, offset + length), one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(offsets - before, lengths) + np.arange(total)


def cut_out(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """The spans as a binary column."""
    lengths = (ends - starts).astype(np.int64)
    data = raw[gathered(starts.astype(np.int64), lengths)]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
