"""Near-duplicate texts: circulant MinHash, banding, and exact Jaccard of character shingles."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orewright.functions.mixing import mix
from orewright.functions.texts import shingle_hashes, spread, text_slices
from orewright.llm.format_duplicates import possible_repeats
from orewright.llm.set_join import mark_table, set_hashes
from orewright.operators.blocks import block_pairs
from orewright.operators.components import components
from orewright.operators.skew import join_totals
from orewright.session import materialize, ship

#: Leading bits of a shingle's hash that the second permutation (a table that every worker holds) orders; shingles that
#: agree in them are ordered by the rest, so that texts of any length have different least shingles.
UNIVERSE_BITS, COORDINATES, BAND_ROWS = 16, 256, 4
#: Shingles whose coordinates are made at once.
SLICE = 2_048
#: 64-bit words of a sketch, one bit for each coordinate.
WORDS = COORDINATES // 64
#: Standard errors by which a sketch may lie below the threshold before a pair is refused without its texts.
MARGIN = 5.5

SKETCH = ", ".join(f"w{i} long" for i in range(WORDS))
SIGNED = f"row long, id long, h1 long, h2 long, n int, {SKETCH}, bands binary"
BANDS = f"hash long, row long, n int, {SKETCH}"


@lru_cache(maxsize=1)
def _permutation(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The second permutation's inverse, and windows of it: row s has it at s, s+1, ..., a shifted copy in each column."""
    shuffled = np.random.default_rng(seed).permutation(1 << UNIVERSE_BITS).astype(np.uint16)
    inverse = np.empty(len(shuffled), np.int64)
    inverse[shuffled] = np.arange(len(shuffled))
    return inverse, np.lib.stride_tricks.sliding_window_view(np.concatenate((shuffled, shuffled[:COORDINATES])), COORDINATES)


def signatures(groups: np.ndarray, hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Circulant MinHash of each group of shingle hashes, sorted by group and hash: in each coordinate the least shingle.

    The first permutation is the shingle's 64-bit hash. Coordinate c orders shingles by the value that the second
    permutation, shifted circularly by c, gives to the leading bits of the hash, and then by the hash.
    """
    inverse, windows = _permutation(seed)
    places = (hashes >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    ends = np.searchsorted(groups, np.arange(n + 1))
    least = np.empty((n, COORDINATES), np.uint16)
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        parts = [windows[places[at : min(at + SLICE, b)]].min(axis=0) for at in range(a, b, SLICE)]
        least[i] = parts[0] if len(parts) == 1 else np.minimum.reduce(parts)
    chosen = (inverse[least] - np.arange(COORDINATES)) & ((1 << UNIVERSE_BITS) - 1)
    keyed = (groups.astype(np.int64) << UNIVERSE_BITS) | places
    return hashes[np.searchsorted(keyed, (np.arange(n)[:, None] << UNIVERSE_BITS) | chosen)]


def sketches(signature: np.ndarray) -> np.ndarray:
    """One hashed bit of each coordinate, packed in words of 64."""
    bits = mix((signature + np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64), 17) >> np.uint64(63)
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def band_keys(signature: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One key for each run of ``rows`` coordinates; the number of the band is part of the key."""
    bands = signature.shape[1] // rows
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix(np.arange(bands), 13), parts.shape[:2])
    for r in range(rows):
        key = mix((key + parts[:, :, r].astype(np.uint64)).astype(np.int64), 14)
    return key.astype(np.int64)


def _sign(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                groups, hashes = shingle_hashes(texts, k)
                held, groups = np.unique(groups, return_inverse=True)
                if not len(held):
                    continue
                signature = signatures(groups, hashes, len(held), seed)
                keys = band_keys(signature)
                columns = [np.arange(row, row + len(held)), part.column(0).to_numpy()[held], *set_hashes(groups, hashes)]
                columns += [np.bincount(groups, minlength=len(held)).astype(np.int32), *sketches(signature).T]
                bands = pa.array([x.tobytes() for x in keys], pa.binary())
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), bands], names=_names(SIGNED))
                row += len(held)

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of (row, n, sketch, bands)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            part = batch.slice(at, 2_000)
            keys = np.frombuffer(b"".join(part.column(part.num_columns - 1).to_pylist()), np.int64)
            times = COORDINATES // BAND_ROWS
            rest = [pa.array(np.repeat(column.to_numpy(), times)) for column in part.columns[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *rest], names=_names(BANDS))


def _may_reach(t: Fraction) -> Column:
    """Whether the sizes and sketches of ``a`` and ``b`` allow the threshold: equal bits are expected in (1 + similarity) / 2."""
    low, high = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    differ = sum((F.bit_count(F.col(f"a.w{i}").bitwiseXOR(F.col(f"b.w{i}"))) for i in range(WORDS)), F.lit(0))
    share = float(1 - t) / 2
    most = COORDINATES * (share + MARGIN * (share * (1 - share) / COORDINATES) ** 0.5)
    return (low * t.denominator >= high * t.numerator) & (differ <= F.lit(int(most)))


def _verify(t: Fraction, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sides = [part.column(part.schema.get_field_index(x)).to_pylist() for x in ("text_a", "text_b")]
                place = {text: i for i, text in enumerate(dict.fromkeys(sides[0] + sides[1]))}
                groups, hashes = shingle_hashes(list(place), k)
                cuts = np.searchsorted(groups, np.arange(len(place) + 1))
                sets = [hashes[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
                a, b = ([sets[place[x]] for x in side] for side in sides)
                overlap = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64) - overlap
                good = overlap * t.denominator >= t.numerator * union
                out = part.select(["a", "b"]).filter(pa.array(good))
                yield out.append_column("similarity", pa.array((overlap / np.maximum(union, 1))[good]))

    return run


def similar_texts(df: DataFrame, id_col: str, text_col: str, threshold: str = "0.6", k: int = 10, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, copies, links): (id, class) of each text with a shingle, the same of classes with several, and (a, b, similarity) of classes.

    Shingles are all runs of ``k`` code points after each CRLF became one space. Texts with one set of shingles are one
    class; one of them stands for it. ``links`` has the pairs of classes that share a band and whose exact Jaccard similarity
    is at least ``threshold``. With 256 coordinates in bands of 4, a pair at 0.6 is missed with a chance of about
    1.4e-4, at 0.7 of 3e-8. Null ids and texts, and texts without a shingle, have no part.

    Texts are read twice: to be signed, and, of candidate pairs only, to be compared. Between these only keys and sketches
    are shuffled: of bands that surely occur once, which are most, nothing is.
    """
    ship(df.sparkSession)
    t = Fraction(threshold)
    plain = df.select(F.col(id_col).cast("long").alias("id"), F.replace(F.col(text_col), F.lit("\r\n"), F.lit(" ")).alias("text"))
    plain = plain.filter(F.col("id").isNotNull() & (F.length("text") >= k))
    signed = materialize(spread(plain).mapInArrow(_sign(k, seed), SIGNED), "signed")
    named = signed.select("row", "id", "h1", "h2")
    several = named.groupBy("h1", "h2").agg(F.min("row").alias("class"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copies = materialize(join_totals(named, several, ["h1", "h2"], "copies").select("row", "id", "class"), "copies")
    others = copies.filter("row != class").select("row")
    firsts = signed.join(others, "row", "left_anti")
    members = firsts.select("id", F.col("row").alias("class")).unionByName(copies.filter("row != class").select("id", "class")).distinct()
    bands = firsts.select("row", "n", *[f"w{i}" for i in range(WORDS)], "bands")
    shared = possible_repeats(bands, BANDS, max(1, signed.count() * (COORDINATES // BAND_ROWS)), expand=_explode, only=True)
    pairs = block_pairs(shared, ["hash"], F.col("row"), _may_reach(t), {"a": F.least("a.row", "b.row"), "b": F.greatest("a.row", "b.row")})
    likely = materialize(pairs.distinct(), "likely_pairs")
    ends = likely.select(F.col("a").alias("row")).unionByName(likely.select(F.col("b").alias("row"))).distinct()
    wanted = materialize(named.join(ends, "row").select("h1", "h2", "id", "row"), "wanted")
    text = _only(plain, mark_table(wanted.select(F.xxhash64("id").alias("h1")))).join(wanted, "id").select("h1", "h2", "text", "row")
    text = materialize(text.mapInArrow(_matching(k), "row long, text string").dropDuplicates(["row"]), "wanted_texts")
    texts = likely.join(text.toDF("a", "text_a"), "a").join(text.toDF("b", "text_b"), "b")
    links = materialize(texts.mapInArrow(_verify(t, k), "a long, b long, similarity double"), "links")
    return members, copies.select("id", "class").distinct(), links


def _matching(k: int):
    """Keeps the texts that have the content hash they were fetched for: an id may come with several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, 2):
                groups, hashes = shingle_hashes(texts, k)
                held, groups = np.unique(groups, return_inverse=True)
                same = np.zeros(len(texts), bool)
                h = set_hashes(groups, hashes)
                same[held] = (h[0] == part.column(0).to_numpy()[held]) & (h[1] == part.column(1).to_numpy()[held])
                yield part.filter(pa.array(same)).select(["row", "text"])

    return run


def _only(plain: DataFrame, table: np.ndarray) -> DataFrame:
    """The texts whose id is marked in a bitmap of fixed size, so that few others are shuffled."""
    bits = len(table).bit_length() - 1
    marked = plain.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def wanted(hashes: pd.Series) -> pd.Series:
        return pd.Series(marked.value[(hashes.to_numpy().astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)])

    return plain.filter(wanted(F.xxhash64("id")))


def similar_text_pairs(df: DataFrame, id_col: str, text_col: str, threshold: str = "0.6", k: int = 10) -> DataFrame:
    """(id_a, id_b), ``id_a`` < ``id_b``: all pairs of different ids that reach the threshold, equal texts too."""
    members, copies, links = similar_texts(df, id_col, text_col, threshold, k)
    sides = {"id_a": F.least("a.id", "b.id"), "id_b": F.greatest("a.id", "b.id")}
    equal = block_pairs(copies, ["class"], F.col("id"), F.lit(True), sides)
    ends = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class"))).distinct()
    held = materialize(members.join(ends, "class"), "linked_members")
    one, other = held.select(F.col("class").alias("a"), F.col("id").alias("x")), held.select(F.col("class").alias("b"), F.col("id").alias("y"))
    linked = links.join(one, "a").join(other, "b").filter("x != y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return equal.unionByName(linked).distinct()


def similar_text_groups(df: DataFrame, id_col: str, text_col: str, threshold: str = "0.6", k: int = 10) -> DataFrame:
    """(id, group_id, links): one row for each id; a group is what chains of similar pairs connect.

    ``group_id`` is the smallest id of the group, ``links`` the number of other classes of texts similar to the
    text's own. Copies of a text are members of its class and never paired. A text without a shingle is a group of its own;
    null ids are left out. An id that comes with several texts has a row for each.
    """
    members, _, links = similar_texts(df, id_col, text_col, threshold, k)
    members = materialize(members, "members")
    found = components(links, "a", "b").toDF("class", "component")
    ends = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class")))
    counted = ends.groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    classes = members.groupBy("class").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).join(found, "class", "left").join(counted, "class", "left")
    classes = materialize(classes.withColumn("component", F.coalesce("component", "class")), "classes")
    least = classes.groupBy("component").agg(F.min("least").alias("group_id"), F.sum("copies").alias("all_copies"))
    grouped = join_totals(classes, least.select("component", "group_id", F.col("all_copies").alias("size")), ["component"], "size")
    grouped = join_totals(members, grouped.select("class", "group_id", "links", "copies"), ["class"], "copies")
    ids = df.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct()
    return ids.join(grouped, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
