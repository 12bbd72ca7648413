"""The sequential triangle estimators as a stateful stream operator, and count windows over their output."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orewright.operators.triest import scale_impr
from orewright.session import ship

#: Edges whose estimates are given out together.
SLICE = 50_000
OUTPUT = "position long, estimate double"
_MASK = (1 << 64) - 1


def _uniform(seed: int, t: int, turn: int) -> float:
    """A number in [0, 1) that depends on its arguments only, so that a replayed batch gives the same state."""
    z = (seed * 0x9E3779B97F4A7C15 + t * 0xD1B54A32D192ED03 + turn * 0x8CB92BA72F3D8DD7) & _MASK
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        z = ((z ^ (z >> shift)) * factor) & _MASK
    return z / 2.0**64


class Reservoir:
    """A bounded sample of edges with the neighbours it implies, and the running triangle estimate."""

    def __init__(self, m: int, improved: bool, seed: int) -> None:
        if m < (2 if improved else 3):
            raise ValueError("the sample is too small for the estimator")
        self.m, self.improved, self.seed = m, improved, seed
        self.t, self.tau = 0, 0.0
        self.edges: list[tuple[int, int]] = []
        self.near: dict[int, set[int]] = {}

    def _common(self, u: int, v: int) -> int:
        return len(self.near.get(u, _NONE) & self.near.get(v, _NONE))

    def _link(self, u: int, v: int) -> None:
        self.near.setdefault(u, set()).add(v)
        self.near.setdefault(v, set()).add(u)

    def _unlink(self, u: int, v: int) -> None:
        for a, b in ((u, v), (v, u)):
            self.near[a].discard(b)
            if not self.near[a]:
                del self.near[a]

    def add(self, u: int, v: int) -> float:
        """Takes the next edge and gives the estimate after it; self-loops and edges in the sample change nothing."""
        self.t += 1
        t, m = self.t, self.m
        if u != v and v not in self.near.get(u, _NONE):
            if self.improved:
                self.tau += self._common(u, v) * scale_impr(t, m)
            if len(self.edges) < m:
                self._insert(u, v, None)
            elif _uniform(self.seed, t, 0) < m / t:
                self._insert(u, v, int(_uniform(self.seed, t, 1) * m))
        if self.improved:
            return self.tau
        return self.tau * max(1.0, t * (t - 1.0) * (t - 2.0) / (float(m) * (m - 1) * (m - 2)))

    def _insert(self, u: int, v: int, slot: int | None) -> None:
        if slot is None:
            self.edges.append((u, v))
        else:
            old = self.edges[slot]
            self._unlink(*old)
            if not self.improved:
                self.tau -= self._common(*old)
            self.edges[slot] = (u, v)
        if not self.improved:
            self.tau += self._common(u, v)
        self._link(u, v)


_NONE: frozenset[int] = frozenset()


def _handler(m: int, improved: bool, seed: int):
    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sample = Reservoir(m, improved, seed)
        if state.exists:
            sample.t, sample.tau, edges = pickle.loads(state.get[0])
            sample.edges = edges
            for edge in edges:
                sample._link(*edge)
        parts = [frame[["seq", "u", "v"]].to_numpy(np.int64) for frame in frames]
        edges = np.concatenate(parts)
        edges = edges[np.lexsort((edges[:, 2], edges[:, 1], edges[:, 0]))]
        for at in range(0, len(edges), SLICE):
            start = sample.t
            estimates = [sample.add(u, v) for _, u, v in edges[at : at + SLICE].tolist()]
            yield pd.DataFrame({"position": np.arange(start + 1, start + 1 + len(estimates)), "estimate": estimates})
        state.update((pickle.dumps((sample.t, sample.tau, sample.edges)),))

    return run


def triest_stream(edges: DataFrame, m: int = 5000, method: str = "IMPR", seed: int = 0) -> DataFrame:
    """(position, estimate) for each edge of a stream of (seq, u, v): the estimate after that edge.

    ``method`` is "BASE" or "IMPR" in any case of letters. One key holds the whole state, as the estimators are sequential; the state has at most
    ``m`` edges and is checkpointed. Edges of one micro-batch, held as 24 bytes each, are taken in the order of ``seq`` (a source
    of many files should set ``maxFilesPerTrigger``); edges with a null
    end are left out. Random choices are hashes of (seed, position), so a replay gives the same estimates.
    """
    if method.upper() not in ("BASE", "IMPR"):
        raise ValueError("method is 'BASE' or 'IMPR'")
    ship(edges.sparkSession)
    keyed = edges.filter("u is not null and v is not null").select(F.lit(0).alias("key"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "seq")
    return keyed.groupBy("key").applyInPandasWithState(_handler(m, method.upper() == "IMPR", seed), OUTPUT, "state binary", "append", GroupStateTimeout.NoTimeout)


def count_windows(estimates: DataFrame, size: int, include_partial: bool = False) -> DataFrame:
    """(window_id, n, estimate): the greatest estimate in each tumbling window of ``size`` positions; full ones only by default."""
    window = F.floor((F.col("position") - 1) / size).cast("long").alias("window_id")
    out = estimates.groupBy(window).agg(F.count(F.lit(1)).alias("n"), F.max("estimate").alias("estimate"))
    return out if include_partial else out.filter(F.col("n") == size)


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all data now present and gives its output table, written below ``path``."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
