"""Vectorised kernels on texts: code points and hashed shingles of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orewright.functions.mixing import mix
from orewright.functions.ragged import ranges
from orewright.session import ship


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts one after another, and the number in each text."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def shingle_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the text, 64-bit hash) of every distinct run of ``k`` code points, sorted by position and hash."""
    points, lengths = code_points(texts)
    count = np.maximum(lengths - k + 1, 0)
    if not count.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.repeat(np.cumsum(lengths) - lengths, count) + ranges(count)
    rolled = np.zeros(len(points) - k + 1, np.uint64)
    for j in range(k):
        rolled = rolled * np.uint64(0x100000001B3) + points[j : j + len(rolled)]
    hashes = mix(rolled[at].astype(np.int64), 11)
    out, kept = [], np.zeros(len(texts), np.int64)
    ends = np.cumsum(count)
    for i, (a, b) in enumerate(zip((ends - count).tolist(), ends.tolist())):
        if b > a:
            own = np.sort(hashes[a:b])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            out.append(own)
            kept[i] = len(own)
    return np.repeat(np.arange(len(texts)), kept), np.concatenate(out)


def text_slices(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about ``most`` characters; a longer text is a part of its own."""
    texts = batch.column(column).to_pylist()
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text or "") > most:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def spread(df: DataFrame) -> DataFrame:
    """More partitions for work that is heavy for each byte; only where the scan gives fewer than the session's parallelism."""
    ship(df.sparkSession)
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(2 * wanted)
