"""Frequent itemsets and association rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.functions.ragged import ranges, unpack
from orewright.operators.skew import index_rows
from orewright.session import materialize, ship

#: Candidates that are broadcast at once; more are counted in several passes over the baskets.
MAX_CANDIDATES = 1_000_000
#: Partial matches that a task holds at once.
STATES = 1_000_000


def distinct_baskets(df: DataFrame, id_col: str, items_col: str) -> DataFrame:
    """(basket_id, item) once each: deliveries of one id are united, null ids and elements are left out."""
    long = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("basket_id"), F.explode(F.array_distinct(items_col)).alias("item"))
    return long.filter("item is not null").distinct()


def find_frequent_items(long: DataFrame, support: float, n: int | None = None, method: str = "apriori", max_size: int | None = None, most: int = MAX_CANDIDATES) -> DataFrame:
    """(items, freq, size): all itemsets of (basket_id, item) held by at least ``support`` times ``n`` baskets.

    ``items`` is sorted; ``n`` is the number of baskets, by default of those that hold an item. "apriori" goes level by
    level: frequent sets that agree but for their last item are joined, candidates with an infrequent subset are dropped by
    semi-joins, and the rest are counted where the baskets lie, ``most`` candidates at a time; only counts are shuffled.
    "fpgrowth" gives the same sets through MLlib. An itemset that no basket holds isn't given even with support 0.
    """
    ship(long.sparkSession)
    long = materialize(long.select("basket_id", "item"), "baskets")
    least = support * (n if n is not None else long.select("basket_id").distinct().count())
    if method == "fpgrowth":
        return _fp_growth(long, least, max_size)
    if method != "apriori":
        raise ValueError("method is 'apriori' or 'fpgrowth'")
    counts = long.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= least)
    named = materialize(index_rows(counts, ["item"], "code"), "frequent_items")
    found = named.select(F.array("item").alias("items"), "freq", F.lit(1).alias("size"))
    if max_size == 1:
        return found
    coded = long.join(named.select("item", F.col("code").cast("int").alias("code")), "item").groupBy("basket_id").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    baskets = materialize(coded.filter(F.size("codes") > 1).select("codes"), "coded_baskets")
    pairs = baskets.mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("freq")).filter(F.col("freq") >= least)
    codes = F.array(F.shiftright("pair", 32).cast("int"), F.col("pair").bitwiseAND(F.lit(2**32 - 1)).cast("int"))
    frequent, size = materialize(pairs.select(codes.alias("codes"), "freq", F.lit(2).alias("size")), "frequent"), 2
    larger = frequent
    while not frequent.isEmpty() and (max_size is None or size < max_size):
        size += 1
        candidates = index_rows(_candidates(frequent.select("codes"), size), ["codes"], "number")
        frequent = materialize(_held(baskets, candidates, size, most).filter(F.col("freq") >= least), "frequent")
        larger = larger.unionByName(frequent)
    item = F.transform(F.sort_array(F.collect_list(F.struct("code", "item"))), lambda x: x["item"])
    spelt = larger.withColumn("code", F.explode("codes")).join(named.select("item", F.col("code").cast("int").alias("code")), "code")
    return found.unionByName(spelt.groupBy("codes", "freq", "size").agg(item.alias("items")).select("items", "freq", "size"))


def _candidates(frequent: DataFrame, size: int) -> DataFrame:
    """Sets of ``size`` codes of which every subset of one less is frequent."""
    split = frequent.select(F.slice("codes", 1, size - 2).alias("head"), F.element_at("codes", -1).alias("tail"))
    wider = split.alias("a").join(split.alias("b"), (F.col("a.head") == F.col("b.head")) & (F.col("a.tail") < F.col("b.tail")))
    wider = wider.select(F.concat("a.head", F.array("a.tail", "b.tail")).alias("codes"))
    for gone in range(1, size - 1):
        without = F.concat(F.slice("codes", 1, gone - 1), F.slice("codes", gone + 1, size))
        wider = wider.withColumn("subset", without).join(frequent.withColumnRenamed("codes", "subset"), "subset", "left_semi").drop("subset")
    return wider


def _later(ends: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index into ``places``, later place in the same basket) for all later places, some STATES at a time."""
    times = ends[places] - places - 1
    total, start = np.cumsum(times), 0
    while start < len(places):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + STATES, side="right")))
        own = times[start:stop]
        index = np.repeat(np.arange(start, stop), own)
        yield index, places[index] + 1 + ranges(own)
        start = stop


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the baskets one after another, and where the basket of each ends."""
    values, rows = unpack(batch.column(0))
    return values.astype(np.int64), np.searchsorted(rows, rows, side="right")


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def sums() -> pa.RecordBatch:
        keys, code = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.bincount(code, np.concatenate([n for _, n in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    for batch in batches:
        codes, ends = _flat(batch)
        for index, place in _later(ends, np.arange(len(codes))):
            held.append(np.unique((codes[index] << 32) | codes[place], return_counts=True))
            size += len(held[-1][0])
            if size > STATES:
                yield sums()
                held, size = [], 0
    if held:
        yield sums()


def _count_candidates(shared):
    """Counts candidates, given as a trie: for each level the sorted (parent node, code) keys of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        totals = np.zeros(len(trie[-1]), np.int64)

        def step(level: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(trie[level], key), len(trie[level]) - 1)
            good = trie[level][at] == key
            return at[good], good

        def descend(level: int, places: np.ndarray, nodes: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> None:
            for index, place in _later(ends, places):
                node, good = step(level, (nodes[index] << 32) | codes[place])
                if level == len(trie) - 1:
                    np.add.at(totals, node, 1)
                elif len(node):
                    descend(level + 1, place[good], node, codes, ends)

        for batch in batches:
            codes, ends = _flat(batch)
            if len(codes):
                node, good = step(0, codes)
                descend(1, np.flatnonzero(good), node, codes, ends)
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(totals[held])], names=["leaf", "n"])

    return run


def _held(baskets: DataFrame, candidates: DataFrame, size: int, most: int) -> DataFrame:
    """(codes, freq, size) of the numbered candidates that a basket holds; ``most`` of them are in the driver at a time."""
    spark, out = baskets.sparkSession, None
    for first in range(1, candidates.count() + 1, most):
        own = candidates.filter(F.col("number").between(first, first + most - 1))
        sets = np.array(own.orderBy("number").select("codes").toArrow().column(0).combine_chunks().flatten().to_numpy()).reshape(-1, size).astype(np.int64)
        trie, node = [], np.zeros(len(sets), np.int64)
        for level in range(size):
            keys, node = np.unique((node << 32) | sets[:, level], return_inverse=True)
            trie.append(keys)
        found = baskets.mapInArrow(_count_candidates(spark.sparkContext.broadcast(trie)), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("freq"))
        # candidates are numbered in the order of their codes, as leaves are
        part = found.select((F.col("leaf") + first).alias("number"), "freq").join(own, "number").select("codes", "freq", F.lit(size).alias("size"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "codes array<int>, freq long, size int")


def _fp_growth(long: DataFrame, least: float, max_size: int | None) -> DataFrame:
    from pyspark.ml.fpm import FPGrowth

    baskets = long.groupBy("basket_id").agg(F.collect_list("item").alias("items"))
    total = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, min(1.0, (least - 0.5) / max(1, total)))).fit(baskets)
    sets = model.freqItemsets.select(F.sort_array("items").alias("items"), F.col("freq").cast("long").alias("freq")).filter(F.col("freq") >= least)
    sized = sets.select("items", "freq", F.size("items").alias("size"))
    return sized if max_size is None else sized.filter(F.col("size") <= max_size)


def get_rules(itemsets: DataFrame, confidence: float) -> DataFrame:
    """(antecedent, consequent, freq, confidence): every split of a frequent itemset whose confidence is reached.

    ``itemsets`` must hold all subsets of its sets. Each set of k items gives its 2^k - 2 proper subsets, whose counts
    come from one equi-join on the sorted items. Both sides may have several items; the comparison includes equality.
    """
    big = itemsets.filter("size > 1").select("items", "freq", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("shiftleft(1L, size)") - 2)).alias("mask"))
    chosen = F.filter("items", lambda _, i: F.getbit(F.col("mask"), i) == 1)
    split = big.select("items", "freq", chosen.alias("antecedent"))
    joined = split.join(itemsets.select(F.col("items").alias("antecedent"), F.col("freq").alias("freq_a")), "antecedent")
    ratio = F.col("freq") / F.col("freq_a")
    return joined.filter(ratio >= confidence).select("antecedent", F.array_except("items", "antecedent").alias("consequent"), "freq", ratio.alias("confidence"))
