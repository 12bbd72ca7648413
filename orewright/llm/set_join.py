"""All pairs of similar sets: extended-prefix join with token combinations, then exact overlap."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.functions.mixing import hashed_counts, mix, slot
from orewright.functions.ragged import pack, ranges, unique_per_group, unpack
from orewright.operators.blocks import block_pairs
from orewright.session import materialize, ship

#: Hashed token counters: a power of two of about a quarter of all elements, within these; 64 MB at most in a worker.
LEAST_COUNTERS, MOST_COUNTERS = 1 << 22, 1 << 25
#: Keys that one set may give; larger sets combine fewer tokens.
KEY_BUDGET = 2_000
#: A prefix token whose counter exceeds the first limit must come with a second shared token, and a second token whose
#: counter exceeds the second limit with a third.
LIMITS = (64, 4096)
#: 64-bit words of the bitmap with which most candidates are refused before their sets are read.
WORDS = 4

MEMBERS = "id long, h1 long, h2 long, n int"
KEYS = "key long, h1 long, h2 long, n int, " + ", ".join(f"w{i} long" for i in range(WORDS))


def _starts(groups: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(groups, prepend=-1))


def set_hashes(groups: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of content hash for each group of distinct items; groups are sorted and not empty."""
    at = _starts(groups)
    return tuple(np.add.reduceat(mix(items, seed), at).astype(np.int64) if len(at) else np.zeros(0, np.int64) for seed in (1, 2))


def _sets_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the rows that hold an element, and the sorted distinct (position, element) pairs."""
    values, rows = unpack(batch.column(1))
    rows, items = unique_per_group(rows, values)
    held, groups = np.unique(rows, return_inverse=True)
    return batch.column(0).to_numpy(zero_copy_only=False)[held], groups, items


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, groups, items = _sets_of(batch)
        h1, h2 = set_hashes(groups, items)
        n = np.bincount(groups, minlength=len(ids)).astype(np.int32)
        first = np.unique(np.stack([ids, h1, h2], axis=1), axis=0, return_index=True)[1]
        yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (ids, h1, h2, n)], names=["id", "h1", "h2", "n"])


def largest_sizes(t: Fraction, budget: int = KEY_BUDGET) -> tuple[float, float]:
    """The largest set whose combinations of three, and of two, prefix tokens stay within the budget of keys."""
    out = []
    for level in (3, 2):
        prefix = level
        while comb(prefix + 1, level) <= budget:
            prefix += 1
        # a set of n has a prefix of n - ceil(t n) + level tokens
        out.append((prefix - level) / float(1 - t) if t < 1 else float("inf"))
    return tuple(out)


def prefix_keys(groups: np.ndarray, items: np.ndarray, counts: np.ndarray, t: Fraction, limits: tuple[int, int] = LIMITS, budget: int = KEY_BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of each set's join keys.

    Tokens are ordered by (hashed count, token). Two sets with similarity of at least t share, for every l up to their
    overlap, l tokens within the first n - ceil(t n) + l tokens of both. Let c1, c2, c3 be the first tokens they share:
    the key is c1 if it is rare, else (c1, c2) if c2 is rare enough, else (c1, c2, c3). The choice depends on the shared
    tokens and on how many tokens may be combined, which the larger set of a pair decides by its size, so that no set gives
    more keys than about the budget; a set gives the keys for every size that a larger partner may have. Sets so small that
    they may share only one or two tokens with a similar set give the shorter keys as well. A token with a counter of 1 is in
    no other set and gives no key.
    """
    order = np.lexsort((items, counts, groups))
    groups, items, counts = groups[order], items[order], counts[order]
    sizes = np.diff(_starts(groups), append=len(groups))
    n = np.repeat(sizes, sizes)
    three, two = largest_sizes(t, budget)
    largest = n * t.denominator // t.numerator
    out = []
    for level, low, high in ((3, 0, three), (2, three, two), (1, two, float("inf"))):
        mine = (largest > low) & (n <= high)
        out.append(_level_keys(groups[mine], items[mine], counts[mine], t, limits, level))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]).astype(np.int64)


def _level_keys(groups: np.ndarray, items: np.ndarray, counts: np.ndarray, t: Fraction, limits: tuple[int, int], level: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets in order that combine at most ``level`` tokens."""
    sizes = np.diff(_starts(groups), append=len(groups))
    place = ranges(sizes)
    n = np.repeat(sizes, sizes)
    need = -(-n * t.numerator // t.denominator)
    possible = (n * (t.denominator - t.numerator) >= t.numerator) & (counts > 1)
    one = np.flatnonzero(possible & (place <= n - need))
    rare = (counts[one] <= limits[0]) | (level < 2)
    alone = one[rare | (need[one] < 2)]
    out = [(groups[alone], mix(items[alone], 3))]
    first = one[~rare]
    later = np.minimum(n - need + 2, n)[first] - place[first] - 1
    i, j = np.repeat(first, later), np.repeat(first + 1, later) + ranges(later)
    two = mix((mix(items[i], 4) + mix(items[j], 5)).astype(np.int64), 6)
    rare = (counts[j] <= limits[1]) | (level < 3)
    enough = rare | (need[i] < 3)
    out.append((groups[i[enough]], two[enough]))
    j, two = j[~rare], two[~rare]
    later = np.minimum(n - need + 3, n)[j] - place[j] - 1
    k = np.repeat(j + 1, later) + ranges(later)
    out.append((groups[k], mix((np.repeat(two, later) + mix(items[k], 7)).astype(np.int64), 8)))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def bitmaps(groups: np.ndarray, items: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each set a bitmap of its elements in ``words`` 64-bit words."""
    bit = mix(items, 9) & np.uint64(64 * words - 1)
    at = _starts(groups)
    out = []
    for w in range(words):
        own = np.where(bit >> np.uint64(6) == w, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
        out.append(np.bitwise_or.reduceat(own, at).astype(np.int64) if len(at) else np.zeros(0, np.int64))
    return out


def _keys(shared, t: Fraction, limits: tuple[int, int], budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                _, groups, items = _sets_of(whole.slice(at, 1_000))
                h = np.stack(set_hashes(groups, items), axis=1)
                distinct = np.zeros(len(h), bool)
                distinct[np.unique(h, axis=0, return_index=True)[1]] = True
                groups, items = groups[distinct[groups]], items[distinct[groups]]
                own, key = prefix_keys(groups, items, table[slot(items, len(table))].astype(np.int64), t, limits, budget)
                n = np.bincount(groups, minlength=len(h)).astype(np.int32)
                words = bitmaps(groups, items)
                place = np.cumsum(distinct) - 1
                columns = [key, h[own, 0], h[own, 1], n[own], *[w[place[own]] for w in words]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "h1", "h2", "n", *[f"w{i}" for i in range(WORDS)]])

    return run


def _verify(t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.num_rows
            (a, ra), (b, rb) = (unpack(batch.column(batch.schema.get_field_index(x))) for x in ("items_a", "items_b"))
            (ra, a), (rb, b) = unique_per_group(ra, a), unique_per_group(rb, b)
            na, nb = np.bincount(ra, minlength=shared), np.bincount(rb, minlength=shared)
            both = np.concatenate([(r.astype(np.uint64) << np.uint64(32)) | (x + 2**31).astype(np.uint64) for r, x in ((ra, a), (rb, b))])
            both.sort()
            overlap = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=shared)
            good = overlap * t.denominator >= t.numerator * (na + nb - overlap)
            out = batch.select(["a1", "a2", "b1", "b2"]).filter(pa.array(good))
            yield out.append_column("similarity", pa.array((overlap / (na + nb - overlap))[good]))

    return run


def _wanted_sets(shared):
    """(h1, h2, items) of the sets whose content hash is marked in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        bits = len(table).bit_length() - 1
        for batch in batches:
            _, groups, items = _sets_of(batch)
            h1, h2 = set_hashes(groups, items)
            wanted = table[(h1.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)]
            first = np.zeros(len(h1), bool)
            first[np.unique(np.stack([h1, h2], axis=1), axis=0, return_index=True)[1]] = True
            wanted &= first
            inside = wanted[groups]
            code = (np.cumsum(wanted) - 1)[groups[inside]]
            lists = pack(code, pa.array(items[inside].astype(np.int32)), int(wanted.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(h1[wanted]), pa.array(h2[wanted]), lists], names=["h1", "h2", "items"])

    return run


def mark_table(hashes: DataFrame, bits: int = 23) -> np.ndarray:
    """A bitmap of fixed size of the leading bits of ``h1``, filled in the cluster by words of 32 places."""
    place = F.shiftrightunsigned(F.col("h1"), 64 - bits)
    words = hashes.select(F.shiftright(place, 5).alias("word"), F.pow(F.lit(2.0), place % 32).cast("long").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def similar_sets(df: DataFrame, id_col: str, set_col: str, threshold: str = "0.8", limits: tuple[int, int] = LIMITS, budget: int = KEY_BUDGET) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, h1, h2, n) of each distinct (id, set), and (a1, a2, b1, b2, similarity) of different sets.

    ``links`` has every pair of different sets, by content hash, with a Jaccard similarity of at least ``threshold``,
    once. Equal sets are one set here: ids that share it are found in ``members``. Null elements are left out, and rows
    with a null id, a null set or no element have no part. An id that comes with several different sets is a member of
    each. Empty inputs give empty results.
    """
    ship(df.sparkSession)
    t = Fraction(threshold)
    plain = df.select(F.col(id_col).cast("long").alias("id"), F.col(set_col).cast("array<int>").alias("items")).filter("id is not null and size(items) > 0")
    members = materialize(plain.mapInArrow(_describe, MEMBERS).groupBy("id", "h1", "h2").agg(F.first("n").alias("n")), "members")
    elements = plain.agg(F.sum(F.size("items"))).first()[0] or 0
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (elements // 4).bit_length()))
    context = df.sparkSession.sparkContext
    table = context.broadcast(np.minimum(hashed_counts(plain, counters), 2**16 - 1).astype(np.uint16))
    keys = plain.mapInArrow(_keys(table, t, limits, budget), KEYS)
    keys = materialize(keys.groupBy("key", "h1", "h2").agg(F.first("n").alias("n"), *[F.first(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), "keys")
    table.destroy()
    low, high = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    need = F.ceil(F.lit(t.numerator) * (F.col("a.n") + F.col("b.n")) / F.lit(t.numerator + t.denominator) - F.lit(1e-9))
    only_a = sum((F.bit_count(F.col(f"a.w{i}").bitwiseAND(F.bitwise_not(F.col(f"b.w{i}")))) for i in range(WORDS)), F.lit(0))
    only_b = sum((F.bit_count(F.col(f"b.w{i}").bitwiseAND(F.bitwise_not(F.col(f"a.w{i}")))) for i in range(WORDS)), F.lit(0))
    keep = (low * t.denominator >= high * t.numerator) & (F.col("a.n") - only_a >= need) & (F.col("b.n") - only_b >= need)
    pairs = block_pairs(keys, ["key"], F.struct("h1", "h2"), keep, {"x": F.struct("a.h1", "a.h2"), "y": F.struct("b.h1", "b.h2")})
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = pairs.select(F.col("x.h1").alias("a1"), F.col("x.h2").alias("a2"), F.col("y.h1").alias("b1"), F.col("y.h2").alias("b2")).distinct()
    pairs = materialize(pairs, "candidates")
    ends = pairs.select(F.col("a1").alias("h1")).unionByName(pairs.select(F.col("b1").alias("h1")))
    marks = context.broadcast(mark_table(ends))
    wanted = plain.mapInArrow(_wanted_sets(marks), "h1 long, h2 long, items array<int>").dropDuplicates(["h1", "h2"])
    wanted = materialize(wanted, "candidate_sets")
    marks.destroy()
    joined = pairs.join(wanted.toDF("a1", "a2", "items_a"), ["a1", "a2"]).join(wanted.toDF("b1", "b2", "items_b"), ["b1", "b2"])
    links = joined.mapInArrow(_verify(t), "a1 long, a2 long, b1 long, b2 long, similarity double")
    return members, materialize(links, "links")


def equal_pairs(members: DataFrame) -> DataFrame:
    """(id_a, id_b) of different ids that hold the same set."""
    keep = F.col("a.id") != F.col("b.id")
    found = block_pairs(members, ["h1", "h2"], F.col("id"), keep, {"x": F.col("a.id"), "y": F.col("b.id")})
    return found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def linked_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b) of the ids of linked sets; AQE splits a set that very many ids hold."""
    a = links.select("a1", "a2", "b1", "b2").join(members.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("id").alias("x")), ["a1", "a2"])
    both = a.join(members.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("id").alias("y")), ["b1", "b2"]).filter("x != y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similar_id_pairs(df: DataFrame, id_col: str, set_col: str, threshold: str = "0.8") -> DataFrame:
    """(id_a, id_b), ``id_a`` < ``id_b``: every pair of different ids whose sets reach the threshold, equal sets too."""
    members, links = similar_sets(df, id_col, set_col, threshold)
    return equal_pairs(members).unionByName(linked_pairs(members, links)).distinct()


def similar_set_classes(df: DataFrame, id_col: str, set_col: str, threshold: str = "0.8") -> DataFrame:
    """(id, class, copies, links): one row for each id, for inputs in which one set may have very many holders.

    ``class`` is the smallest id with the same set, ``copies`` the number of ids that hold it, and ``links`` the number
    of other classes that are similar to it. Ids with several sets are in the row of each.
    """
    members, links = similar_sets(df, id_col, set_col, threshold)
    classes = members.groupBy("h1", "h2").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies"))
    ends = links.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).unionByName(links.select(F.col("b1").alias("h1"), F.col("b2").alias("h2")))
    counted = classes.join(ends.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("links")), ["h1", "h2"], "left")
    return members.select("id", "h1", "h2").join(counted, ["h1", "h2"]).select("id", "class", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
