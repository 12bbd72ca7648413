"""Most frequent items in three phases with a threshold; memory is bounded on every node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.llm.sets import add_counts, by_id, merge_sets, node_count, read_sets
from orewright.session import materialize

LOCAL = "node int, item int, n long, place long"


def _count_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One node's local counts, its leaders first."""
    _, _, items = merge_sets(list(batches))
    values, counts = add_counts(items)
    order = np.lexsort((values, -counts))
    node = np.full(len(values), TaskContext.get().partitionId(), np.int32)
    for at in range(0, len(order), 200_000):
        part = order[at : at + 200_000]
        columns = [pa.array(node[: len(part)]), pa.array(values[part].astype(np.int32)), pa.array(counts[part]), pa.array(np.arange(at, at + len(part)))]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "item", "n", "place"])


def local_counts(df: DataFrame, id_col: str, set_col: str, nodes: int) -> DataFrame:
    """(node, item, n, place): every node's counts of its own ids, written once to the shared folder.

    All deliveries of an id reach one node, so that an id counts once for an item and the counts of nodes add up.
    """
    return materialize(by_id(read_sets(df, id_col, set_col), nodes).mapInArrow(_count_node, LOCAL), "local_counts")


def _kth(sums: DataFrame, column: str, k: int) -> int:
    """The ``k``-th largest value, 0 if there are fewer."""
    rows = sums.orderBy(F.desc(column)).limit(k).select(column).collect()
    return rows[-1][0] if len(rows) == k else 0


def top_items(df: DataFrame, id_col: str, set_col: str, k: int, nodes: int | None = None) -> DataFrame:
    """(item, baskets): the ``k`` items held by the most distinct ids, with exact counts.

    Phase 1 sums the ``k`` local leaders of each node; the ``k``-th partial sum is a lower bound. Phase 2 fetches every
    local count of at least bound / nodes: an item that no node reports can't reach the bound. The better bound
    found then drops items whose upper bound lies below it. Phase 3 resolves the remaining items exactly. At equal
    counts the smaller item goes first. Null ids, null elements, null and empty sets count for nothing; an
    element repeated within an id counts once; fewer than ``k`` items give all of them.
    """
    nodes = nodes or node_count(df)
    local = local_counts(df, id_col, set_col, nodes)
    leaders = local.filter(F.col("place") < k).groupBy("item").agg(F.sum("n").alias("low"))
    share = -(-_kth(leaders, "low", k) // nodes)
    fetched = local.filter(F.col("n") >= share).groupBy("item").agg(F.sum("n").alias("low"), F.count(F.lit(1)).alias("reports"))
    fetched = materialize(fetched.withColumn("high", F.col("low") + (nodes - F.col("reports")) * max(0, share - 1)), "candidates")
    candidates = fetched.filter(F.col("high") >= _kth(fetched, "low", k)).select("item")
    exact = local.join(candidates, "item", "left_semi").groupBy("item").agg(F.sum("n").alias("baskets"))
    return exact.orderBy(F.desc("baskets"), "item").limit(k)
