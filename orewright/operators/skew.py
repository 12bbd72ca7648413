"""Per-key results without hot tasks: exact offset chunking.

Rows of every key are counted per input partition, the counts are prefix-summed into offsets, every row gets its
number within its key, and keys are worked on in chunks of equal size whose ordered boundary states are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orewright.session import materialize

#: Entries of the offset table up to which it is broadcast; beyond it the offsets are joined by (key, partition).
MAX_BROADCAST_OFFSETS = 200_000


class _Codes:
    """Dense codes of values met batch by batch, exact for every Arrow type with equality; null is a value of its own."""

    def __init__(self) -> None:
        self.known: pa.Array | None = None

    def __call__(self, column: pa.Array) -> np.ndarray:
        if self.known is None:
            self.known = column.slice(0, 0)
        found = pc.index_in(column, value_set=self.known)
        if found.null_count:
            new = pc.unique(column.filter(found.is_null()))
            self.known = pa.concat_arrays([self.known, new])
            found = pc.index_in(column, value_set=self.known)
        return found.to_numpy(zero_copy_only=False).astype(np.int64)


class _Counters:
    """How often each 64-bit key was seen, as sorted arrays."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The running number of each occurrence, from 0, over all calls."""
        distinct, code, n = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.argsort(code, kind="stable")
        local = np.empty(len(keys), np.int64)
        local[order] = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
        at = np.searchsorted(self.keys, distinct)
        held = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        held[inside] = self.keys[at[inside]] == distinct[inside]
        base = np.zeros(len(distinct), np.int64)
        base[held] = self.counts[at[held]]
        self.counts[at[held]] += n[held]
        self.keys, self.counts = np.insert(self.keys, at[~held], distinct[~held]), np.insert(self.counts, at[~held], n[~held])
        return local + base[code]


def _number_partitions(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        columns, folds, seen = [_Codes() for _ in keys], [_Codes() for _ in keys], _Counters()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            code = np.zeros(n, np.int64)
            for key, column, fold in zip(keys, columns, folds):
                code = fold(pa.array((code << 32) | column(batch.column(batch.schema.get_field_index(key)))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(seen.number(code))],
                names=[*batch.schema.names, "_part", "_local"],
            )

    return run


def number_rows(df: DataFrame, keys: list[str], chunk_rows: int = 50_000) -> DataFrame:
    """Adds ``key_row`` (0-based number within the key, in partition order) and ``chunk`` (``key_row div chunk_rows``).

    One pass tags each row with its partition and its number inside (partition, key) and writes the tagged rows to the
    shared folder, so that counting and numbering see the same rows whatever is recomputed. Offsets are a prefix sum
    over at most one row per (partition, key). Only keys longer than one chunk need offsets; there are at most
    rows/chunk_rows of them. Null keys are a key of their own; keys of any type with equality are told apart exactly. The columns ``_part``, ``_local``, ``key_row``,
    ``chunk`` must not exist in ``df``. An empty input gives an empty result.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])
    tagged = materialize(df.mapInArrow(_number_partitions(keys), schema), "tagged")
    long = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")).filter(F.col("_total") > chunk_rows)
    long = materialize(long.select(*[F.col(k).alias(f"_k_{k}") for k in keys]), "long_keys")
    same_key = F.lit(True)
    for k in keys:
        same_key = same_key & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    if long.count() <= MAX_BROADCAST_OFFSETS:
        long = F.broadcast(long)
    counts = tagged.select(*keys, "_part").join(long, same_key, "left_semi").groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    offsets = materialize(offsets, "offsets")
    if offsets.count() <= MAX_BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    numbered = tagged.join(offsets, same_key & (F.col("_part") == F.col("_p")), "left").withColumn("key_row", F.col("_local") + F.coalesce("_offset", F.lit(0)))
    return numbered.withColumn("chunk", F.floor(F.col("key_row") / chunk_rows).cast("long")).select(*df.columns, "key_row", "chunk")


def chunk_states(numbered: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """One state for each (key, chunk): ``rows``, ``first_row``, ``last_row`` and the given aggregates."""
    return numbered.groupBy(*keys, "chunk").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("key_row").alias("first_row"),
        F.max("key_row").alias("last_row"),
        *[c.alias(name) for name, c in aggs.items()],
    )


def merge_states(states: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """(keys, sums, chunks): the ordered chunk states of each key, merged; a state that doesn't continue its predecessor is an error."""
    order = Window.partitionBy(*keys).orderBy("chunk")
    joined = states.withColumn("_expected", F.coalesce(F.lag("last_row").over(order) + 1, F.lit(0)))
    checked = F.when(F.col("first_row") == F.col("_expected"), F.lit(1)).otherwise(F.raise_error(F.lit("the chunks of a key don't join")).cast("int"))
    return joined.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.sum(checked).alias("chunks"))


def key_rows(df: DataFrame, keys: list[str], chunk_rows: int = 50_000) -> DataFrame:
    """(keys, rows, chunks) for every key of ``df``, through chunks of equal size."""
    numbered = number_rows(df.select(*keys), keys, chunk_rows)
    return merge_states(chunk_states(numbered, keys), keys, ["rows"])


def incidences(edges: DataFrame, links: DataFrame) -> DataFrame:
    """(origin, vertex, neighbour): each edge once at both ends (a self-loop at one), each link at its ``src``.

    An end that is null gives no row; the other end keeps its row, with a null neighbour.
    """
    other = F.when(F.col("u").eqNullSafe(F.col("v")), F.lit(None)).otherwise(F.struct(F.col("v").alias("vertex"), F.col("u").alias("neighbour")))
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("vertex"), F.col("v").alias("neighbour")), other)).alias("e"))
    return both.select(F.lit("edges").alias("origin"), "e.vertex", "e.neighbour").filter("vertex is not null").unionByName(
        links.filter("src is not null").select(F.lit("graph_links").alias("origin"), F.col("src").cast("long").alias("vertex"), F.col("dst").cast("long").alias("neighbour"))
    )


def hot_vertices(edges: DataFrame, links: DataFrame, one_in: int = 100, chunk_rows: int = 50_000) -> DataFrame:
    """(origin, vertex, rows) of the vertices that hold at least one in ``one_in`` of all rows of their table, nulls included."""
    totals = edges.agg(F.count(F.lit(1)).alias("all_rows")).withColumn("origin", F.lit("edges")).unionByName(
        links.agg(F.count(F.lit(1)).alias("all_rows")).withColumn("origin", F.lit("graph_links"))
    )
    rows = key_rows(incidences(edges, links), ["origin", "vertex"], chunk_rows)
    return rows.join(F.broadcast(totals), "origin").filter(F.col("rows") * one_in >= F.col("all_rows")).select("origin", "vertex", "rows")


def vertex_degrees(edges: DataFrame, links: DataFrame, chunk_rows: int = 50_000) -> DataFrame:
    """(origin, vertex, rows, neighbours) of every vertex: its rows and its distinct other ends (itself left out)."""
    keys = ["origin", "vertex"]
    distinct = ordered_neighbours(incidences(edges, links))
    numbered = number_rows(distinct, keys, chunk_rows)
    states = chunk_states(numbered, keys, all_rows=F.sum("n"), neighbours=F.count(F.when(F.col("neighbour") != F.col("vertex"), 1)))
    return merge_states(states, keys, ["all_rows", "neighbours"]).select(*keys, F.col("all_rows").alias("rows"), "neighbours")


def ordered_neighbours(incident: DataFrame) -> DataFrame:
    """(origin, vertex, neighbour, n) once for each pair, in sorted partitions; repeated rows are summed before the sort."""
    pairs = incident.groupBy("origin", "vertex", "neighbour").agg(F.count(F.lit(1)).alias("n"))
    return pairs.repartitionByRange("origin", "vertex", "neighbour").sortWithinPartitions("origin", "vertex", "neighbour")


def neighbour_lists(edges: DataFrame, links: DataFrame, chunk_rows: int = 50_000) -> DataFrame:
    """(origin, vertex, chunk, first_row, neighbours): the sorted neighbours of every vertex in lists of bounded length.

    A vertex with more than ``chunk_rows`` neighbours has several lists; list ``chunk`` begins at neighbour number
    ``first_row``, and no neighbour lies in two lists. Null neighbours and the vertex itself are left out.
    """
    keys = ["origin", "vertex"]
    pairs = ordered_neighbours(incidences(edges, links).filter(F.col("neighbour") != F.col("vertex")))
    states = chunk_states(number_rows(pairs, keys, chunk_rows), keys, neighbours=F.sort_array(F.collect_list("neighbour")))
    return states.select(*keys, "chunk", "first_row", "neighbours")


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str], count: str, many: int = 100_000, most: int = MAX_BROADCAST_OFFSETS) -> DataFrame:
    """``rows`` inner-joined with ``totals`` (one row for each key, ``count`` of its rows) without hot tasks.

    Keys with more than ``many`` rows are joined where their rows lie; all others by a shuffle. If there are more than
    ``most`` such keys, the ``most`` largest are: any other key then has less than one in ``most`` of all rows, and no
    task can suffer from it.
    """
    hot = materialize(totals.filter(F.col(count) > many).orderBy(F.desc(count)).limit(most), "hot_totals")
    if hot.isEmpty():
        return rows.join(totals, keys)
    names = F.broadcast(hot.select(*keys))
    cold = rows.join(names, keys, "left_anti").join(totals.join(names, keys, "left_anti"), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def running_sums(df: DataFrame, order: list[str], name: str = "position", value: Column | None = None) -> DataFrame:
    """Adds the sum of ``value`` (a whole number; 1 by default) over all rows up to each row in the order of the given columns.

    No row is brought to one task: rows are range-partitioned and sorted, tagged with the sum inside their partition and
    written once; the total of each partition is prefix-summed and joined back. The order must be unique for a defined result.
    """
    value = F.lit(1) if value is None else value

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = batch.schema.get_field_index("_value")
            sums = np.cumsum(batch.column(place).to_numpy(zero_copy_only=False)) + total
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_local"])
            total = int(sums[-1]) if batch.num_rows else total

    valued = df.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0).cast("long")))
    schema = T.StructType([*valued.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])
    tagged = materialize(valued.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tag, schema), "indexed")
    sizes = tagged.groupBy("_part").agg(F.sum("_value").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return tagged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_local") + F.col("_offset")).select(*df.columns, name)


def index_rows(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Adds the 1-based place of each row in the order of the given columns, without bringing the rows to one task."""
    return running_sums(df, order, name)
