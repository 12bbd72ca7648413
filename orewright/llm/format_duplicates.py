"""Duplicates hidden by formatting: merged Bloom filters tell possible repeats, only those are grouped exactly."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.functions.mixing import mix
from orewright.operators.skew import join_totals
from orewright.session import default_parallelism, discard, materialize, ship

#: Filter bits for each row, and slices of the filter (each key has one bit in each slice).
BITS_PER_ROW, SLICES = 8, 4
#: Bits of the smallest filter, and of the largest that is broadcast (64 MB). More rows are written once by ranges of their
#: hash, and each range has a filter of its own, filled from and applied to the rows of that range only.
LEAST_BITS, MAX_BITS = 1 << 13, 1 << 29
_BLOCK = 1 << 17


class SeenTwice:
    """Two bit arrays, of places hit and of places hit at least twice; merging keeps every repeated key recognisable.

    A key that occurs in two partitions has all its bits in both ``once`` arrays, hence in their intersection, which a
    merge adds to ``twice``.
    """

    def __init__(self, bits: int) -> None:
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def places(self, hashes: np.ndarray, k: int) -> np.ndarray:
        width = self.bits // SLICES
        return (mix(hashes, 20 + k) & np.uint64(width - 1)).astype(np.int64) + k * width

    def add(self, hashes: np.ndarray) -> None:
        for k in range(SLICES):
            place, n = np.unique(self.places(hashes, k), return_counts=True)
            for array, chosen in ((None, place), (self.twice, place[n > 1])):
                if not len(chosen):
                    continue
                byte, at = np.unique(chosen >> 3, return_index=True)
                mask = np.bitwise_or.reduceat(np.uint8(1) << (chosen & 7).astype(np.uint8), at)
                if array is None:
                    self.twice[byte] |= self.once[byte] & mask
                    self.once[byte] |= mask
                else:
                    array[byte] |= mask


def maybe_repeated(twice: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each key may have been seen more than once; never false for one that was."""
    model = SeenTwice.__new__(SeenTwice)
    model.bits = len(twice) * 8
    out = np.ones(len(hashes), bool)
    for k in range(SLICES):
        place = SeenTwice.places(model, hashes, k)
        out &= (twice[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return out


def _fill(bits: int, expand: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, any_row = None, False
        for batch in expand(batches):
            if batch.num_rows:
                seen = seen or SeenTwice(bits)
                seen.add(batch.column(batch.schema.get_field_index("hash")).to_numpy())
                any_row = True
        for at in range(0, bits // 8 if any_row else 0, _BLOCK):
            once, twice = seen.once[at : at + _BLOCK], seen.twice[at : at + _BLOCK]
            if once.any():
                columns = [[at // _BLOCK], [zlib.compress(once.tobytes(), 1)], [zlib.compress(twice.tobytes(), 1)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["block", "once", "twice"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice))
            if block in held:
                a, b = held[block]
                held[block] = a | once, b | twice | (a & once)
            else:
                held[block] = once, twice
    for block, (_, twice) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(twice.tobytes(), 1)])], names=["block", "twice"])


def repeat_filter(df: DataFrame, rows: int, bits_per_row: int = BITS_PER_ROW, expand: Callable = iter) -> np.ndarray:
    """The ``twice`` array for the column ``hash`` of what ``expand`` makes of the batches, filled by partition and merged by block."""
    bits = min(MAX_BITS, max(LEAST_BITS, 1 << (rows * bits_per_row - 1).bit_length()))
    nodes = default_parallelism(df.sparkSession)
    filled = df.mapInArrow(_fill(bits, expand), "block int, once binary, twice binary").repartition(nodes, "block")
    twice = np.zeros(bits // 8, np.uint8)
    for block, data in filled.mapInArrow(_merge, "block int, twice binary").toLocalIterator():
        part = np.frombuffer(zlib.decompress(data), np.uint8)
        twice[block * _BLOCK : block * _BLOCK + len(part)] = part
    return twice


def _mark(shared, expand: Callable, only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in expand(batches):
            maybe = pa.array(maybe_repeated(shared.value, batch.column(batch.schema.get_field_index("hash")).to_numpy()))
            yield batch.filter(maybe) if only else batch.append_column("maybe", maybe)

    return run


def possible_repeats(df: DataFrame, schema: str, rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS, expand: Callable = iter, only: bool = False) -> DataFrame:
    """The rows that ``expand`` makes of ``df`` (of that ``schema``, with a 64-bit ``hash``) and ``maybe``: false where the hash surely occurs once.

    ``rows`` is about their number; with ``only`` the possible repeats alone are given. The result is written to the shared
    folder and the broadcast filter dropped. If one filter would be too large, the rows are first written once in folders
    by ranges of the hash; each range is then filtered by itself, so the work stays in proportion to the rows and the
    filter's false positives stay as few, however many rows there are.
    """
    ranges, out = max(1, -(-rows * bits_per_row // max(LEAST_BITS, max_bits))), None
    held = df
    if ranges > 1:
        made = df if expand is iter else df.mapInArrow(expand, schema)
        held, expand = materialize(made.withColumn("_range", F.pmod(F.shiftright("hash", 32), F.lit(ranges)).cast("int")), "ranges", ["_range"]), iter
    for r in range(ranges):
        own = held if ranges == 1 else held.filter(F.col("_range") == r).drop("_range")
        hashes = own.select("hash") if expand is iter else own
        shared = df.sparkSession.sparkContext.broadcast(repeat_filter(hashes, -(-rows // ranges), bits_per_row, expand))
        part = materialize(own.mapInArrow(_mark(shared, expand, only), schema if only else f"{schema}, maybe boolean"), "marked")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    discard(*[held] * (ranges > 1))
    return out


def edge_records(lines: DataFrame, id_col: str = "line_id", line_col: str = "line") -> DataFrame:
    """(id, low, high, kind) of the lines that hold an edge record.

    No record: null ids and lines, comments (first non-blank character ``%``), lines without exactly two runs of ASCII
    digits or without an ASCII letter. The kind is all letters in lower case; leading zeros of a vertex don't count.
    """
    line = F.col(line_col)
    runs = F.regexp_extract_all(line, F.lit("([0-9]+)"), 1)
    vertex = [F.regexp_replace(F.get("runs", F.lit(i)), "^0+(?=.)", "") for i in (0, 1)]
    kept = lines.filter(F.col(id_col).isNotNull() & line.rlike("[A-Za-z]") & ~line.rlike(r"(?U)^\s*%"))
    split = kept.select(F.col(id_col).cast("long").alias("id"), runs.alias("runs"), F.lower(F.regexp_replace(line, r"\P{L}+", "")).alias("kind"))
    return split.filter(F.size("runs") == 2).select("id", F.least(*vertex).alias("low"), F.greatest(*vertex).alias("high"), "kind")


def collapse(records: DataFrame, keys: list[str], rows: int | None = None, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """(each record once: keys, first_id, copies; each repeat: first_id, id) of records with an ``id`` and canonical ``keys``.

    Records whose key surely occurs once are given out as they are; only possible repeats are shuffled and grouped
    exactly, so a false positive of the filter costs time and changes nothing. ``rows`` is a bound on the records.
    Ids must be unique. Null keys are equal to each other. An empty input gives empty results.
    """
    ship(records.sparkSession)
    hashed = records.select("id", *keys, F.xxhash64(*keys).alias("hash"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hashed.schema)
    marked = possible_repeats(hashed, schema, max(1, rows if rows is not None else records.count()), bits_per_row, max_bits)
    possible = marked.filter("maybe")
    groups = possible.groupBy(*keys).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    once = marked.filter("not maybe").select(*keys, F.col("id").alias("first_id"), F.lit(1).cast("long").alias("copies"))
    several = groups.filter("copies > 1").select(F.struct(*keys).alias("key"), "first_id", "copies")
    repeats = join_totals(possible.select(F.struct(*keys).alias("key"), "id"), several, ["key"], "copies").filter("id != first_id").select("first_id", "id")
    return once.unionByName(groups), repeats
