"""Writers: round reports, text, and any table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orewright.functions.texts import spread


def write_report(metrics: DataFrame, path: str, mode: str = "overwrite", **parameters: object) -> None:
    """A tab-separated table with a header; the parameters of the run are columns of their own."""
    named = metrics.withColumns({name: F.lit(value) for name, value in parameters.items()}) if parameters else metrics
    named.write.mode(mode).option("sep", "\t").option("header", "true").csv(path)


def write_text(df: DataFrame, column: str, path: str, append: bool = False) -> None:
    """One line for each row."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("append" if append else "overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """A table in any format that Spark has, partitioned by columns if wanted."""
    writer = df.write.format(kind).mode(mode)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_documents(df: DataFrame, id_col: str, text_col: str, path: str) -> list[str]:
    """Writes each row's text and a line end as a file of its own, named by its id; the folders that hold them.

    Workers write the files themselves: Spark's writer makes a folder, a checksum file and, on a local disk, processes that set
    permissions for each file. Each attempt of a task has a folder of its own, and only those that ended are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        context = TaskContext.get()
        folder = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        count = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if not count:
                    system.create_dir(f"{root}/{folder}", recursive=True)
                with system.open_output_stream(f"{root}/{folder}/file_id={'' if key is None else key}_{count}.txt") as out:
                    out.write((text or b"") + b"\n")
                count += 1
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([folder])], names=["folder"])

    written = spread(df.select(id_col, text_col)).mapInArrow(run, "folder string").collect()
    return [f"{path}/{row.folder}" for row in written]
