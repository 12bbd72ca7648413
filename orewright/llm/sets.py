"""Set-valued records: one sorted set for each id, whatever was delivered twice.

Shared by the counting, pairing and joining operators of this subpackage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.functions.mixing import slot
from orewright.functions.ragged import pack, unique_per_group, unpack
from orewright.session import default_parallelism, materialize, ship

#: Rows that a node unites in its memory at most, on average.
NODE_ROWS = 250_000
SETS = "id long, items array<int>"
SET_SCHEMA = pa.schema([("id", pa.int64()), ("items", pa.list_(pa.int32()))])


def set_batch(ids: np.ndarray, groups: np.ndarray, items: np.ndarray) -> pa.RecordBatch:
    """A batch of sets: ``groups`` are positions in ``ids``, sorted together with ``items``."""
    return pa.RecordBatch.from_arrays([pa.array(ids), pack(groups, pa.array(items.astype(np.int32)), len(ids))], schema=SET_SCHEMA)


def merge_sets(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of the batches, and the distinct (position in ids, item) pairs in order."""
    ids, groups, items, start = [], [], [], 0
    for batch in batches:
        values, rows = unpack(batch.column(1))
        ids.append(batch.column(0).to_numpy(zero_copy_only=False))
        groups.append(rows + start)
        items.append(values)
        start += batch.num_rows
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, code = np.unique(np.concatenate(ids), return_inverse=True)
    return distinct, *unique_per_group(code[np.concatenate(groups)], np.concatenate(items))


def _within_batch(keep: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, groups, items = merge_sets([batch])
            if keep is not None:
                wanted = keep[slot(items, len(keep))]
                groups, items = groups[wanted], items[wanted]
            held, code = np.unique(groups, return_inverse=True)
            if len(held):
                yield set_batch(ids[held], code, items)

    return run


def read_sets(df: DataFrame, id_col: str, set_col: str, keep: np.ndarray | None = None) -> DataFrame:
    """(id, items): the non-null elements of each row as a sorted set, rows of one id within an Arrow batch united.

    Rows without an id or without any element are left out. ``keep`` may name the slots whose items are wanted.
    """
    ship(df.sparkSession)
    plain = df.select(F.col(id_col).cast("long").alias("id"), F.col(set_col).cast("array<int>").alias("items"))
    return plain.filter("id is not null and size(items) > 0").mapInArrow(_within_batch(keep), SETS)


def node_count(df: DataFrame) -> int:
    """Partitions for ``by_id``: the session's number, and more where that would leave a node with too many rows."""
    return max(default_parallelism(df.sparkSession), -(-df.count() // NODE_ROWS))


def by_id(sets: DataFrame, nodes: int) -> DataFrame:
    """All parts of one id in one partition. A repeated id has come down to one part for each batch before this."""
    return sets.repartition(nodes, "id")


def add_counts(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their (summed) counts."""
    if counts is None:
        return np.unique(values, return_counts=True)
    distinct, code = np.unique(values, return_inverse=True)
    return distinct, np.bincount(code, counts, len(distinct)).astype(np.int64)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of each id in a partition, united."""
    ids, groups, items = merge_sets(list(batches))
    cuts = np.searchsorted(groups, np.arange(0, len(ids) + 10_000, 10_000))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        own = ids[k * 10_000 : (k + 1) * 10_000]
        if len(own):
            yield set_batch(own, groups[a:b] - k * 10_000, items[a:b])


def one_set_each(df: DataFrame, id_col: str, set_col: str, keep: np.ndarray | None = None) -> DataFrame:
    """(id, items): one sorted set for each id that holds an item, written to the shared folder."""
    return materialize(by_id(read_sets(df, id_col, set_col, keep), node_count(df)).mapInArrow(_merge, SETS), "sets")
