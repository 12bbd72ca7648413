"""Readers: text files as documents, baskets, edge lists, point matrices, adjacency files and part files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orewright.operators.skew import MAX_BROADCAST_OFFSETS
from orewright.session import materialize


#: Tasks for each core that read documents at most.
READ_TASKS = 16


def base_name(path: Column) -> Column:
    """The last segment of a path."""
    return F.element_at(F.split(path, "/"), -1)


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, doc_id, text): one row for each file, ``doc_id`` its last path segment; the full path stays the key.

    Spark plans a task for each few files however small they are; READ_TASKS tasks for a core at most read them one after another.
    """
    files = spark.read.text(path, wholetext=True).coalesce(READ_TASKS * spark.sparkContext.defaultParallelism).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select("path", base_name(F.col("path")).alias("doc_id"), F.replace("text", F.lit("\r\n"), F.lit(" ")).alias("text"))


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(line, value): lines with their 0-based number in the order of files and lines; with ``keep`` only kept lines count.

    Each block of a file is read in order, so a line's number is that of its block's first line and its place in the block.
    Only a row for each block is brought together to number the blocks.
    """
    text = spark.read.text(path)
    text = text if keep is None else text.filter(keep)
    placed = text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    blocks = placed.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), "line_offsets")
    if offsets.count() <= MAX_BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    return placed.join(offsets, ["_file", "_block"]).select((F.col("_offset") + F.col("_row") - F.col("_first")).alias("line"), "value")


def items_of(line: Column) -> Column:
    """The distinct integers of a line of numbers parted by white space; empty parts and other words are left out."""
    return F.array_distinct(F.filter(F.transform(F.split(line, r"\s+"), lambda x: x.try_cast("int")), lambda x: x.isNotNull()))


def read_baskets(spark: SparkSession, path: str) -> DataFrame:
    """(basket_id, items): one basket for each line that isn't blank."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    return lines.select(F.col("line").alias("basket_id"), items_of(F.col("value")).alias("items"))


def edge_of(line: Column) -> Column:
    """(u, v) of a line that begins with two integers, whatever follows; null for comments (``%``), blank and other lines."""
    pattern = r"^\s*(\d+)\s+(\d+)(?:\s|$)"
    u, v = (F.regexp_extract(line, pattern, i).try_cast("long") for i in (1, 2))
    return F.when(u.isNotNull() & v.isNotNull(), F.struct(u.alias("u"), v.alias("v")))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(seq, u, v) of an edge list in the order of the file; comments and other lines are left out."""
    parsed = numbered_lines(spark, path).select(F.col("line").alias("seq"), edge_of(F.col("value")).alias("e"))
    return parsed.filter("e is not null").select("seq", "e.u", "e.v")


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) of edge files that arrive in a folder."""
    return spark.readStream.text(path).select(edge_of(F.col("value")).alias("e")).filter("e is not null").select("e.u", "e.v")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(id, features) of a numeric CSV file without a header."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    return lines.select(F.col("line").alias("id"), F.transform(F.split("value", ","), lambda x: F.trim(x).cast("double")).alias("features"))


def read_adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((id), (src, dst)) of a file whose first line gives the size and whose line i lists the neighbours of vertex i.

    Comment lines (``%`` or ``#``) are taken out before vertices are numbered from 1; an empty line is a vertex without
    neighbours.
    """
    lines = numbered_lines(spark, path, ~F.col("value").rlike(r"^\s*[%#]")).withColumnRenamed("line", "id").filter("id > 0")
    near = F.filter(F.transform(F.split("value", r"\s+"), lambda x: x.try_cast("long")), lambda x: x.isNotNull())
    return lines.select("id"), lines.select(F.col("id").alias("src"), F.explode(near).alias("dst"))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(id, part): line i is the part of vertex i, from 1."""
    return numbered_lines(spark, path).filter(F.trim("value") != "").select((F.col("line") + 1).alias("id"), F.trim("value").cast("int").alias("part"))


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A table by its file ending: parquet, orc, json, csv or plain text."""
    kind = next((k for k in ("parquet", "orc", "json", "csv") if path.rstrip("/").endswith(k)), "text")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None and kind != "text" else reader).load(path)
