"""Vectorised helpers over Arrow string columns, used inside ``mapInArrow`` tasks.

Texts are handled as one byte array with offsets per batch slice, so that words, lines and their hashes are found by
numpy over millions of bytes at once. Nothing here keeps state that grows with the input.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text bytes that one step looks at; a longer single text is a step of its own.
SLICE_BYTES = 2 << 20

# The C library keeps freed memory unless told (glibc only).
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_MASK = (1 << 64) - 1

SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False

EXACT = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = EXACT.copy()
FOLDED[0x41:0x5B] = EXACT[0x61:0x7B]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``limit`` bytes of ``column``, and at least one row."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        step = np.cumsum(size)
        first = 0
        while first < batch.num_rows:
            before = step[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(step, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last
    # The worker lives on; what this task has freed is for the executor's other tasks.
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, null as empty, and the offset of each row plus the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of the first word of each row (plus the total)."""
    solid = SOLID[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begin[first], end[last] = solid[first], solid[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(value: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    value = value ^ (value >> np.uint64(30))
    value = value * np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(27)
    value = value * np.uint64(0x94D049BB133111EB)
    value ^= value >> np.uint64(31)
    return value


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, length: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < length:
        table = np.full(1 << max(16, (length - 1).bit_length()), base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if length <= 4 * SLICE_BYTES:
            _powers[base] = table
    return table


def prefix_sums(data: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
    """Running sums from which ``span_hashes`` takes the hash of any span."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    terms = table[data]
    terms *= _power_table(_MULTIPLIER, len(data) + 1)[: len(data)]
    np.cumsum(terms, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal bytes give equal hashes wherever they stand."""
    value = sums[ends] - sums[starts]
    value *= _power_table(_INVERSE, len(sums))[starts]
    value += (ends - starts).astype(np.uint64)
    return mix(value)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = True) -> np.ndarray:
    return span_hashes(prefix_sums(data, FOLDED if folded else EXACT), starts, ends)


def chain(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbouring values (fewer than ``size`` values: none)."""
    count = max(0, len(hashes) - size + 1)
    value = hashes[:count].copy()
    for step in range(1, size):
        value *= np.uint64(_MULTIPLIER)
        value += hashes[step : step + count]
    return mix(value)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of each item, from the first item of each row."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums_within(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` in each row's stretch."""
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(values: np.ndarray) -> np.ndarray:
    """True where a value occurs twice or more in the array."""
    ordered = np.sort(values)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    return found_in(twice, values)


def found_in(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """True where a value is in the sorted array ``ordered``."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
