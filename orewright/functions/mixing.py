"""Seeded mixing of 64-bit integers, and tables of hashed counters filled in the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orewright.functions.ragged import unpack
from orewright.session import default_parallelism

#: Counters that are sent together.
_BLOCK = 1 << 16


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit bijective mixing of integers."""
    z = x.astype(np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def slot(values: np.ndarray, slots: int) -> np.ndarray:
    """The place of each value in a table of ``slots`` (a power of two) hashed counters."""
    mixed = values.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)


def hashed_counts(sets: DataFrame, slots: int) -> np.ndarray:
    """How many elements of (any, list) fall into each of ``slots`` hashed counters: never less than any value's own number.

    The table has ``slots`` places whatever the input holds. Partitions count by themselves and send the counters they
    touched, block by block; blocks are summed in the cluster, and only the sums come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int32)
        for batch in batches:
            values, _ = unpack(batch.column(1))
            if len(values) * 8 > slots:
                total += np.bincount(slot(values, slots), minlength=slots).astype(np.int32)
            elif len(values):
                place, n = np.unique(slot(values, slots), return_counts=True)
                total[place] += n.astype(np.int32)
        for block in range(0, slots, _BLOCK):
            own = total[block : block + _BLOCK]
            held = np.flatnonzero(own)
            if len(held):
                columns = [pa.array([block // _BLOCK]), *(pa.array([x.tobytes()], pa.binary()) for x in (held.astype(np.uint16), own[held]))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "place", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, place, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = sums.setdefault(block, np.zeros(_BLOCK, np.int64))
                own[np.frombuffer(place, np.uint16)] += np.frombuffer(n, np.int32)
        for block, own in sums.items():
            held = np.flatnonzero(own)
            columns = [pa.array([block]), *(pa.array([x.tobytes()], pa.binary()) for x in (held.astype(np.uint16), np.minimum(own[held], 2**31 - 1).astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "place", "n"])

    nodes = default_parallelism(sets.sparkSession)
    sent = sets.mapInArrow(count, "block long, place binary, n binary").repartition(nodes, "block")
    table = np.zeros(max(slots, _BLOCK), np.int32)
    for block, place, n in sent.mapInArrow(add, "block long, place binary, n binary").toLocalIterator():
        table[block * _BLOCK + np.frombuffer(place, np.uint16).astype(np.int64)] = np.frombuffer(n, np.int32)
    return table[:slots]
