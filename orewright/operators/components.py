"""Connected components of an undirected graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.session import discard, materialize


def components(links: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(vertex, component) for every vertex of a link; the component is its smallest vertex.

    Each round takes the smallest label among the neighbours and then the label's own label, so that a chain shortens
    by half or more. Labels are written to the shared folder after each round; only the number of changed labels comes
    to the driver. Links with a null end are left out; self-loops make their vertex known. ValueError if ``rounds``
    don't suffice.
    """
    plain = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    arcs = materialize(plain.unionByName(plain.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "arcs")
    written = labels = materialize(arcs.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("c")), "labels")
    for _ in range(rounds):
        near = arcs.join(labels.select(F.col("x").alias("y"), F.col("c").alias("d")), "y").groupBy("x").agg(F.min("d").alias("d"))
        moved = labels.join(near, "x").select("x", "c", F.least("c", "d").alias("d"))
        jumped = moved.join(labels.select(F.col("x").alias("d"), F.col("c").alias("e")), "d", "left").select("x", "c", F.least("d", F.coalesce("e", "d")).alias("d"))
        stepped = materialize(jumped, "labels")
        discard(written)
        written = stepped
        labels = stepped.select("x", F.col("d").alias("c"))
        if stepped.filter("d < c").isEmpty():
            return labels.select(F.col("x").alias("vertex"), F.col("c").alias("component"))
    raise ValueError(f"labels still change after {rounds} rounds")
