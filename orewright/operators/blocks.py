"""Pairs within groups, worked on in blocks so that no group is one task's burden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orewright.session import materialize

#: Members of a group that are paired in one task; larger groups are cut into blocks of about this size.
BLOCK = 1_000
#: Large groups whose keys are broadcast at most; beyond it they are told apart by a join.
MAX_BROADCAST_KEYS = 200_000


def block_pairs(members: DataFrame, key: list[str], order: Column, keep: Column, columns: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of members of one group for which ``keep`` holds, projected to ``columns``.

    ``members`` has each member of a group once; ``order`` is its unique place (a column of ``members``), used to form
    each pair once. ``keep`` and ``columns`` name the two sides as ``a.x`` and ``b.x``. Groups of up to ``block`` members
    meet in one self-join, whose sides share their shuffle. A larger group is cut into blocks by a hash of ``order``, and
    every pair of blocks is a cell of the join, so that the rows of a large group spread over many tasks. Members with a
    null key are in no group.
    """
    placed = members.withColumn("_order", order)
    sizes = members.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > block)
    large = materialize(sizes.select(*key, F.ceil(F.col("_size") / block).cast("int").alias("_blocks")), "large_groups")
    same = F.lit(True)
    for k in key:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    out = [c.alias(name) for name, c in columns.items()]
    several = large.count()
    if several and several <= MAX_BROADCAST_KEYS:
        large = F.broadcast(large)
    small = placed.join(large.select(*key), key, "left_anti") if several else placed
    pairs = small.alias("a").join(small.alias("b"), same & (F.col("a._order") < F.col("b._order")) & keep).select(*out)
    if not several:
        return pairs
    sized = placed.join(large, key).withColumn("_own", F.pmod(F.xxhash64("_order"), F.col("_blocks")).cast("int"))
    a = sized.withColumn("_other", F.explode(F.sequence(F.col("_own"), F.col("_blocks") - 1)))
    b = sized.withColumn("_other", F.col("_own")).withColumn("_own", F.explode(F.sequence(F.lit(0), F.col("_own"))))
    cell = same & (F.col("a._own") == F.col("b._own")) & (F.col("a._other") == F.col("b._other"))
    once = (F.col("a._own") < F.col("a._other")) | (F.col("a._order") < F.col("b._order"))
    return pairs.unionByName(a.alias("a").join(b.alias("b"), cell & once & keep).select(*out))
