"""A uniform sample of fixed size from pieces of unknown length."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orewright.session import materialize, ship

#: Columns of a state: the sampled row as a struct, which reservoir it lies in, how many rows that stands for, and the
#: row's place in its random order. A reservoir of an empty partition has no row.
STATE = ["row", "reservoir", "population", "place"]
#: Reservoirs that are merged into one by a task.
FAN = 64


class Skips:
    """Positions (0-based) that enter a reservoir of ``m`` and the slot each takes, drawing skips instead of coins."""

    def __init__(self, m: int, rng: np.random.Generator) -> None:
        self.m, self.rng, self.weight = m, rng, 1.0
        self.next = 0

    def within(self, start: int, n: int) -> tuple[list[int], list[int]]:
        """Offsets and slots among positions ``start`` .. ``start + n - 1``."""
        at, slots = [], []
        while self.next < start + n:
            at.append(self.next - start)
            if self.next < self.m:
                slots.append(self.next)
                self.next += 1
                if self.next < self.m:
                    continue
            else:
                slots.append(int(self.rng.integers(self.m)))
                self.next += 1
            self.weight *= (1.0 - self.rng.random()) ** (1.0 / self.m)
            gap = math.log(1.0 - self.rng.random()) / math.log1p(-self.weight) if self.weight < 1.0 else 0.0
            self.next += int(min(gap, 2.0**62))
        return at, slots


def _fill(m: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, part])
        skips, seen, taken, held = Skips(m, rng), 0, [], 0
        where = np.zeros(m, np.int64)
        for batch in batches:
            at, slots = skips.within(seen, batch.num_rows)
            seen += batch.num_rows
            if at:
                taken.append(pa.Table.from_batches([batch]).take(pa.array(at)))
                for i, slot in enumerate(slots):
                    where[slot] = held + i
                held += len(at)
            if held > 4 * m + 10_000:
                taken, held = [pa.concat_tables(taken).take(pa.array(where))], m
                where = np.arange(m)
        size = min(m, seen)
        if size:
            rows = pa.concat_tables(taken).take(pa.array(where[:size][rng.permutation(size)]))
            for name, value in zip(STATE[1:], (np.full(size, part, np.int64), np.full(size, seen, np.int64), np.arange(size))):
                rows = rows.append_column(name, pa.array(value))
            yield from rows.to_batches(max_chunksize=10_000)

    return run


def reservoirs(df: DataFrame, m: int, seed: int) -> DataFrame:
    """The state of a sample: at most ``m`` rows of each partition with the number of rows they stand for.

    States of several pieces can be joined with ``union_states`` and drawn from together.
    """
    if m < 1:
        raise ValueError("m must be at least 1")
    ship(df.sparkSession)
    schema = T.StructType([T.StructField("row", df.schema), *[T.StructField(name, T.LongType()) for name in STATE[1:]]])
    return materialize(df.select(F.struct("*").alias("row")).mapInArrow(_fill(m, seed), schema), "reservoirs")


def _merge(m: int, seed: int):
    """Reservoirs of one group in, one reservoir for all their rows out."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        table = table.sort_by([("reservoir", "ascending"), ("place", "ascending")])
        reservoir, population, place = (table.column(c).to_numpy() for c in STATE[1:])
        first = np.flatnonzero(place == 0)
        sizes = population[first]
        rng = np.random.default_rng([seed, group + 1, len(first)])
        quota = rng.multivariate_hypergeometric(sizes, min(m, int(sizes.sum())), method="marginals")
        kept = np.flatnonzero(place < np.repeat(quota, np.diff(first, append=len(place))))
        rows = table.column("row").take(pa.array(rng.permutation(kept)))
        columns = [rows, *(pa.array(x) for x in (np.full(len(kept), group), np.full(len(kept), sizes.sum()), np.arange(len(kept))))]
        return pa.Table.from_arrays(columns, names=STATE)

    return run


def merge_reservoirs(states: DataFrame, m: int, seed: int, fan: int = FAN) -> DataFrame:
    """The same state in at most ``fan`` reservoirs: groups of ``fan`` are merged at a time, as a tree.

    How many rows each reservoir gives to the merged one is a multivariate hypergeometric draw by the rows they stand for,
    so what is left of many partitions' reservoirs before the last draw is at most ``fan`` times ``m`` rows.
    """
    level = 0
    while (names := states.filter("place = 0").count()) > fan:
        level += 1
        order = Window.orderBy("reservoir")
        numbers = states.filter("place = 0").select("reservoir", F.floor((F.row_number().over(order) - 1) / fan).cast("long").alias("group"))
        grouped = states.join(F.broadcast(numbers) if names <= 1_000_000 else numbers, "reservoir")
        states = materialize(grouped.groupBy("group").applyInArrow(_merge(m, seed + level), states.schema), "reservoirs")
    return states


def union_states(states: list[DataFrame]) -> DataFrame:
    """One state from the states of different pieces; the reservoirs keep apart by a running piece number."""
    out = None
    for k, state in enumerate(states):
        own = state.withColumn("reservoir", F.col("reservoir") + F.lit(k << 32))
        out = own if out is None else out.unionByName(own)
    return out


def draw(states: DataFrame, m: int, seed: int) -> DataFrame:
    """A uniform sample of ``m`` rows, or of all if there are fewer, from reservoirs of at least ``m`` each.

    How many rows each reservoir gives is a multivariate hypergeometric draw by the numbers of rows they stand for;
    since a reservoir lies in random order, its first rows are a uniform choice. Only the numbers, one for each
    reservoir, come to the driver.
    """
    sizes = sorted((r[0], r[1]) for r in states.filter("place = 0").select("reservoir", "population").collect())
    total = sum(n for _, n in sizes)
    picked = sorted(random.Random(seed).sample(range(total), min(m, total)))
    bounds = np.cumsum([n for _, n in sizes], dtype=object) if sizes else []
    given = np.bincount(np.searchsorted(np.array(bounds, np.int64), picked, side="right"), minlength=len(sizes)) if picked else []
    quota = states.sparkSession.createDataFrame([(r, int(n)) for (r, _), n in zip(sizes, given)], "reservoir long, quota long")
    return states.join(F.broadcast(quota), "reservoir").filter(F.col("place") < F.col("quota")).select("row.*")


def sample(df: DataFrame, m: int, seed: int) -> DataFrame:
    """``m`` rows of ``df`` (all, if there are fewer), every row equally likely, in one pass over the data.

    Each partition fills a reservoir, reservoirs are merged as a tree, and the sample is drawn from the last of them.

    Repeated rows and rows with nulls are rows like any other; all columns are kept, whatever their names. An empty
    input gives an empty sample. The result is the same for the same seed and the same partitions.
    """
    return draw(merge_reservoirs(reservoirs(df, m, seed), m, seed), m, seed)
