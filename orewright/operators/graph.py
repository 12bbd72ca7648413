"""Undirected graphs: canonical edges, degrees, triangles and their growth along the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.operators.skew import index_rows, running_sums
from orewright.session import materialize


def canonical_edges(edges: DataFrame, u: str = "u", v: str = "v", seq: str | None = None) -> DataFrame:
    """(u, v) with ``u`` < ``v`` once each, and with ``seq`` the first place at which the edge came.

    Self-loops and edges with a null end are left out; both directions and repetitions are one edge.
    """
    ends = edges.filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    low, high = F.least(u, v).alias("u"), F.greatest(u, v).alias("v")
    if seq is None:
        return ends.select(low, high).distinct()
    return ends.select(low, high, F.col(seq).alias("seq")).groupBy("u", "v").agg(F.min("seq").alias("seq"))


def both_directions(edges: DataFrame) -> DataFrame:
    """(src, dst): each canonical edge in both directions."""
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))).alias("e")).select("e.*")


def degrees(edges: DataFrame) -> DataFrame:
    """(vertex, degree) of canonical edges."""
    return edges.select(F.explode(F.array("u", "v")).alias("vertex")).groupBy("vertex").agg(F.count(F.lit(1)).alias("degree"))


def triangles(edges: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(a, b, c) of each triangle of canonical edges once, and for each column in ``carry`` its three values as an array.

    Edges point from the end of lower degree to the end of higher (the id decides equal ones), so that no vertex, however
    many neighbours it has, has more than about sqrt(2 m) edges going out, and the paths to be closed stay few.
    """
    carry = carry or []
    known = degrees(edges)
    placed = edges.join(known.toDF("u", "du"), "u").join(known.toDF("v", "dv"), "v")
    forward = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    placed = placed.select(F.when(forward, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(forward, F.col("v")).otherwise(F.col("u")).alias("y"), *carry)
    placed = materialize(placed, "oriented")
    first, second, third = (placed.select(F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"), *[F.col(c).alias(f"{c}{i}") for c in carry]) for i in (1, 2, 3))
    wedges = first.join(second, F.col("x1") == F.col("x2")).filter(F.col("y1") != F.col("y2"))
    closed = wedges.join(third, (F.col("y1") == F.col("x3")) & (F.col("y2") == F.col("y3")))
    corners = F.sort_array(F.array("x1", "y1", "y2"))
    out = closed.select(corners.alias("k"), *[F.array(*[F.col(f"{c}{i}") for i in (1, 2, 3)]).alias(c) for c in carry])
    return out.select(F.get("k", F.lit(0)).alias("a"), F.get("k", F.lit(1)).alias("b"), F.get("k", F.lit(2)).alias("c"), *carry)


def triangles_per_vertex(edges: DataFrame) -> DataFrame:
    """(vertex, triangles) of every vertex, 0 included."""
    corners = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("vertex")).groupBy("vertex").agg(F.count(F.lit(1)).alias("n"))
    return degrees(edges).select("vertex").join(corners, "vertex", "left").select("vertex", F.coalesce("n", F.lit(0)).alias("triangles"))


def triangle_count_windows(edges: DataFrame, size: int, include_partial: bool = False) -> DataFrame:
    """(window_id, n, estimate): the exact number of triangles seen by the end of each tumbling window of ``size`` edges.

    ``edges`` are canonical with their ``seq``; a triangle is seen when its last edge comes. The count never falls, so
    its greatest value in a window is the one at the window's end. The last window is given only if it is full or
    ``include_partial`` is set. Only one row for each window is summed, by ranges of windows.
    """
    placed = index_rows(edges, ["seq", "u", "v"])
    window = F.floor((F.col("position") - 1) / size).cast("long").alias("window_id")
    closing = triangles(placed, ["position"]).select(F.array_max("position").alias("position"))
    closed = closing.select(window).groupBy("window_id").agg(F.count(F.lit(1)).alias("closed"))
    full = placed.select(window).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"))
    seen = running_sums(full.join(closed, "window_id", "left"), ["window_id"], "seen", F.col("closed"))
    out = seen.select("window_id", "n", F.col("seen").cast("double").alias("estimate"))
    return out if include_partial else out.filter(F.col("n") == size)
