"""Items that appear together: pair counts with large-basket blocking, and how far they exceed chance."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.functions.mixing import hashed_counts
from orewright.functions.ragged import ranges
from orewright.llm.sets import add_counts, one_set_each, read_sets
from orewright.session import default_parallelism, materialize

#: Items in a block; a set with more is cut into blocks, and every pair of blocks is work of its own.
BLOCK = 64
#: Partial pair counts that a task holds before it hands them on.
HELD = 2_000_000
WORK = "a array<int>, b array<int>, turn long"
PAIRS = "item_a int, item_b int, n long"


def _to_blocks(block: int):
    """Large sets in, pairs of blocks out: ``b`` is null for the pairs within ``a``; ``turn`` spreads them over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            for items in batch.column(1):
                values = items.values.to_numpy()
                parts = [values[at : at + block] for at in range(0, len(values), block)]
                for i, part in enumerate(parts):
                    for rest in (parts[at : at + 1000] for at in range(i + 1, len(parts), 1000)):
                        yield _work([part] * len(rest), _lists(rest), turn)
                        turn += len(rest)
                yield _work(parts, pa.nulls(len(parts), pa.list_(pa.int32())), turn)
                turn += len(parts)

    return run


def _work(a: list[np.ndarray], b: pa.Array, turn: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_lists(a), b, pa.array(np.arange(turn, turn + len(a)))], names=["a", "b", "turn"])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32)))


def _within(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All pairs inside each list of sorted values, as one 64-bit key for each."""
    index = ranges(lengths)
    later = np.repeat(lengths, lengths) - index - 1
    first = np.repeat(np.arange(len(values)), later)
    return _key(values[first], values[first + 1 + ranges(later)])


def _across(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """All pairs between two lists of each row."""
    times = np.repeat(b_len, a_len)
    starts = np.repeat(np.cumsum(b_len) - b_len, a_len)
    return _key(np.repeat(a, times), b[np.repeat(starts, times) + ranges(times)])


def _key(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (low.astype(np.int64) << 32) | (high.astype(np.int64) + 2**31)


class _Sums:
    """Pair counts in bounded memory: ``full`` gives out partial counts when too many pairs are held."""

    def __init__(self) -> None:
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        distinct, counts = add_counts(keys)
        self.keys.append(distinct)
        self.counts.append(counts)
        self.size += len(distinct)

    def full(self) -> bool:
        if self.size > HELD:
            keys, counts = add_counts(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.size = [keys], [counts], len(keys)
        return self.size > HELD // 2

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            keys, counts = add_counts(np.concatenate(self.keys), np.concatenate(self.counts))
            self.__init__()
            for at in range(0, len(keys), 200_000):
                yield _pairs(keys[at : at + 200_000], counts[at : at + 200_000])


def _ordinary_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            sets = batch.column(1).slice(at, 1000)
            sums.add(_within(sets.flatten().to_numpy(), sets.value_lengths().to_numpy().astype(np.int64)))
            if sums.full():
                yield from sums.flush()
    yield from sums.flush()


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            a, b = (batch.column(i).slice(at, 200) for i in (0, 1))
            alone = b.is_null()
            within, left, right = a.filter(alone), a.filter(pc.invert(alone)), b.drop_null()
            for sets in (within, left, right):
                assert sets.null_count == 0
            sums.add(_within(within.flatten().to_numpy(), within.value_lengths().to_numpy().astype(np.int64)))
            sums.add(_across(left.flatten().to_numpy(), left.value_lengths().to_numpy().astype(np.int64), right.flatten().to_numpy(), right.value_lengths().to_numpy().astype(np.int64)))
            if sums.full():
                yield from sums.flush()
    yield from sums.flush()


def _pairs(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    low, high = (keys >> 32).astype(np.int32), ((keys & 0xFFFFFFFF) - 2**31).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(counts)], names=["item_a", "item_b", "n"])


def _count_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [add_counts(batch.column(1).flatten().to_numpy()) for batch in batches]
    if held:
        values, counts = add_counts(np.concatenate([v for v, _ in held]), np.concatenate([n for _, n in held]))
        yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32)), pa.array(counts.astype(np.int64))], names=["item", "n"])


def pair_counts(sets: DataFrame, min_count: int = 1, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((item, n), (item_a, item_b, n)) with ``item_a`` < ``item_b`` and n of at least ``min_count``.

    ``sets`` has one sorted set for each id. Pairs of ordinary sets are summed where the sets lie. A set of more than
    ``block`` items is cut into blocks; each pair of blocks is a row of its own that any task may take, so the
    largest set is nobody's burden. Tasks sum pairs in bounded memory before the shuffle.
    """
    nodes = default_parallelism(sets.sparkSession)
    singles = sets.mapInArrow(_count_items, "item int, n long").groupBy("item").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    ordinary = sets.filter(F.size("items").between(2, block)).mapInArrow(_ordinary_pairs, PAIRS)
    work = sets.filter(F.size("items") > block).mapInArrow(_to_blocks(block), WORK).repartition(nodes, "turn")
    partial = ordinary.unionByName(work.mapInArrow(_block_pairs, PAIRS))
    return singles, partial.groupBy("item_a", "item_b").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def associated_pairs(df: DataFrame, id_col: str, set_col: str, min_share: str = "0.005", min_lift: int = 3, block: int = BLOCK) -> DataFrame:
    """(item_a, item_b, n, n_a, n_b, n_all, lift): pairs held by at least ``min_share`` of the ids, lift at least ``min_lift``.

    n_all counts the distinct ids that hold any item; lift is n * n_all / (n_a * n_b), compared without rounding.
    Items that can't reach the share by a hashed upper bound of their count are left out of the sets first, which
    changes no result; a share of 0 and a lift of 0 give all pairs. Null ids, null elements, null and empty sets count for nothing; ids delivered again and
    elements repeated within an id count once. An empty input gives an empty result.
    """
    raw = read_sets(df, id_col, set_col)
    n_all = raw.select("id").distinct().count()
    share = Fraction(min_share)
    min_count = max(1, -(-n_all * share.numerator // share.denominator))
    keep = None
    if min_count > 1:
        slots = 1 << max(10, min(22, int(512 / float(share)).bit_length()))
        keep = hashed_counts(raw, slots) >= min_count
    singles, pairs = pair_counts(one_set_each(df, id_col, set_col, keep), min_count, block)
    singles = materialize(singles, "frequent_items")
    if singles.count() <= 200_000:
        singles = F.broadcast(singles)
    named = pairs.join(singles.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a").join(
        singles.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b"
    )
    product = F.col("n_a").cast("decimal(19,0)") * F.col("n_b").cast("decimal(19,0)")
    held = named.filter(F.col("n").cast("decimal(19,0)") * F.lit(n_all).cast("decimal(19,0)") >= product * F.lit(min_lift))
    lift = F.col("n").cast("double") * n_all / (F.col("n_a").cast("double") * F.col("n_b").cast("double"))
    return held.select("item_a", "item_b", "n", "n_a", "n_b", F.lit(n_all).cast("long").alias("n_all"), lift.alias("lift"))
