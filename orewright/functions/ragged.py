"""Vectorised kernels on list columns: a list column is a value array plus row offsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and their row numbers of a list column; null lists count as empty, null elements are left out."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    rows = np.repeat(np.arange(len(lengths)), lengths)
    if values.null_count:
        valid = values.is_valid().to_numpy(zero_copy_only=False)
        values, rows = values.drop_null(), rows[valid]
    return values.to_numpy(zero_copy_only=False), rows


def unique_per_group(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, value) pairs in order; groups are small non-negative integers, values 32-bit integers."""
    key = (groups.astype(np.uint64) << np.uint64(32)) | (values.astype(np.int64) + 2**31).astype(np.uint64)
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> np.uint64(32)).astype(np.int64), ((key & np.uint64(0xFFFFFFFF)).astype(np.int64) - 2**31)


def pack(groups: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """A list column of ``n`` rows from values sorted by group number."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(groups, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..length-1 for every length, one after another."""
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(starts, lengths)
