"""Sorted partitions as Arrow tables that never tear a run of equal keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], column: str, least: int) -> Iterator[pa.Table]:
    """Tables of at least ``least`` rows (but for the last) that end where ``column`` changes."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        key = table.column(column).to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
            held = table.slice(cut).combine_chunks().to_batches()
            rows -= cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def pairs_within(key: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of equal keys in a sorted array, at most about ``most`` at a time."""
    n = len(key)
    if not n:
        return
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, n])
    partners = np.repeat(start + size, size) - np.arange(n) - 1  # rows after each one in its run
    ends = np.cumsum(partners)
    a = 0
    while a < n:
        base = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + most, "right")))
        i = np.repeat(np.arange(a, b), partners[a:b])
        if len(i):
            first = np.repeat(ends[a:b] - partners[a:b] - base, partners[a:b])
            yield i, i + 1 + np.arange(len(i)) - first
        a = b
