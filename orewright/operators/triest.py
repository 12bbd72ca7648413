"""Triangle estimates from a bounded sample of an edge stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orewright.functions.hashing import md5_int
from orewright.operators.graph import triangles


def scale_base(t: Column, m: int) -> Column:
    """By how much the triangles within a sample of ``m`` of ``t`` edges are multiplied."""
    t = t.cast("double")
    return F.greatest(F.lit(1.0), t * (t - 1) * (t - 2) / float(m * (m - 1) * (m - 2)))


def scale_impr(t: int, m: int) -> float:
    """The weight of a triangle that edge number ``t`` closes with a sample of ``m`` edges."""
    return max(1.0, (t - 1) * (t - 2) / float(m * (m - 1)))


def bottom_sample(edges: DataFrame, m: int, seed: int) -> DataFrame:
    """The ``m`` edges with the smallest seeded hash: a uniform sample that only depends on the set of edges."""
    name = F.concat(F.lit(f"{seed}:"), F.col("u").cast("string"), F.lit("-"), F.col("v").cast("string"))
    return edges.withColumn("h", F.md5(name)).orderBy("h", "u", "v").limit(m).drop("h")


def triest_base(edges: DataFrame, m: int, seed: int) -> DataFrame:
    """(t, sampled, triangles, estimate) at the end of the stream of canonical edges, in one distributed pass.

    On a simple graph the sequential counter always equals the number of triangles within the sample, and the ``m``
    smallest hashes are a uniform ``m``-subset as a reservoir is; so no sequential code is needed. ``m`` >= 3.
    """
    if m < 3:
        raise ValueError("m must be at least 3")
    sample = bottom_sample(edges.select("u", "v"), m, seed)
    total = edges.agg(F.count(F.lit(1)).alias("t"))
    inside = triangles(sample).agg(F.count(F.lit(1)).alias("triangles"))
    both = total.join(F.broadcast(inside))
    return both.select("t", F.least("t", F.lit(m)).cast("long").alias("sampled"), "triangles", (F.col("triangles") * scale_base(F.col("t"), m)).alias("estimate"))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a seed and columns, the same whenever it is computed again."""
    return md5_int(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])) / float(1 << 32)
