"""Vectors of scaled integers, from arrays of floats in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Integer components stay below this size, so that distances and products of up to 1024 components fit 64 bits.
LARGEST = 1 << 26


def kept_vectors(column: pa.Array, dimensions: int | None = None) -> np.ndarray:
    """Which rows hold a vector without null and non-finite components (of ``dimensions`` of them, where given; never an empty one)."""
    lists = column.cast(pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    good = sizes == dimensions if dimensions is not None else sizes > 0
    parents = pc.list_parent_indices(lists).to_numpy()
    values = lists.flatten()
    bad = ~np.isfinite(pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False))
    good[parents[bad]] = False
    return good


def scaled(column: pa.Array, factor: int) -> np.ndarray:
    """``floor(factor * x)`` of every component x, taken as a double; all rows must be kept and of one length. A row per vector."""
    values = column.cast(pa.large_list(pa.float64())).flatten().to_numpy(zero_copy_only=False)
    whole = np.floor(factor * values)
    if len(whole) and np.abs(whole).max() >= LARGEST:
        raise ValueError(f"a component times {factor} is {LARGEST} or more")
    return whole.astype(np.int64).reshape(len(column), -1)
