"""Helpers for functions over Arrow batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Return memory that is free to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidy(run: Run) -> Run:
    """The function over batches, giving free memory back before it and after it.

    Workers live on from task to task.  What one task has left free (at its end
    the function itself is still there, so again before the next one) would else
    count beside the executor's JVM for good.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def strings(column: pa.Array) -> list[str | None]:
    """The texts of a string column; bytes that are no UTF-8 read as U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: Python holds a slice's texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal (non-null) integer or binary keys in a sorted stream, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for k in keys:
            col = batch.column(k)
            v = col.to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(batch.column(k)[n - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Tables of ``least`` rows or more (but the last) that never split a run of equal keys of a sorted stream."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cut = 0  # the last place in this batch where a key begins
        new = np.zeros(n, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
            if held:
                new[0] |= held[-1].column(k)[held[-1].num_rows - 1].as_py() != batch.column(k)[0].as_py()
        starts = np.flatnonzero(new)
        if rows + n >= least and len(starts):
            cut = int(starts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)], batch.schema)
            held, rows = [], 0
        held.append(batch.slice(cut))
        rows += n - cut
    if held:
        yield pa.Table.from_batches(held)
