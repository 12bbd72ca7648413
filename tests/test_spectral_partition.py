import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orewright.operators import graph, partition, spectral


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    centres = [(0, 0), (8, 0), (0, 8)]
    rows = [(i, (np.array(centres[i % 3]) + rng.normal(0, 0.4, 2)).tolist()) for i in range(60)]
    return spark.createDataFrame([*rows, (999, None)], "id long, features array<double>"), rows


def test_weights(blobs):
    df, rows = blobs
    x = np.array([r[1] for r in rows])
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    pairs = spectral.distances(df, block=17)
    got = pairs.toPandas()
    assert len(got) == 60 * 59 and np.allclose(got.d2, d2[got.i, got.j])
    w = np.exp(-d2 / (2 * 1.5**2))
    np.fill_diagonal(w, 0)
    lap = w / np.sqrt(np.outer(w.sum(0), w.sum(0)))
    got = spectral.laplacian(spectral.affinity(pairs)).toPandas()
    assert np.allclose(got.w, lap[got.i, got.j])


@pytest.mark.parametrize("local", [0, 2048])
def test_clusters(blobs, local, monkeypatch):
    monkeypatch.setattr(spectral, "LOCAL_POINTS", local)
    df, _ = blobs
    got = {r.id: r.cluster for r in spectral.spectral_cluster(df, k=3).collect()}
    groups = {frozenset(i for i in got if got[i] == c) for c in set(got.values())}
    assert groups == {frozenset(range(s, 60, 3)) for s in range(3)}


@pytest.mark.parametrize("rows,kept", [(2048, 8), (37, 2)])
def test_vectors_without_stored_affinity(spark, monkeypatch, rows, kept):
    """Leading vectors of overlapping points as a dense solver gives them, and no affinity is written for many points."""
    monkeypatch.setattr(spectral, "ROWS", rows)
    monkeypatch.setattr(spectral, "KEPT", kept)
    x = np.random.default_rng(4).normal(0, 2.5, (150, 3))
    x[0] = 1e6  # a point far from all others
    w = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 1.5**2))
    np.fill_diagonal(w, 0)
    root = np.sqrt(np.outer(w.sum(0), w.sum(0)))
    values, vectors = np.linalg.eigh(np.divide(w, root, out=np.zeros_like(w), where=root > 0))
    found = spectral.point_vectors(spark, x, 4, 1.5)
    assert np.allclose(np.abs((found * vectors[:, ::-1][:, :4]).sum(0)), 1, atol=1e-6)
    monkeypatch.setattr(spectral, "LOCAL_POINTS", 50)
    monkeypatch.setattr(spectral, "affinity", None)
    points = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, features array<double>")
    assert spectral.spectral_cluster(points, 2).count() == 150


def test_sigma(blobs, spark):
    df, _ = blobs
    got = spectral.optimal_sigma(df, k=3, sigmas=[0.5, 1.0, 6.0]).collect()
    assert sum(r.best for r in got) == 1 and min(got, key=lambda r: r.cost).best
    assert spectral.spectral_cluster(spark.createDataFrame([], "id long, features array<double>")).count() == 0


@pytest.fixture(scope="module")
def ring(spark):
    rng = random.Random(2)
    pairs = {(i, (i + d) % 80) for i in range(80) for d in (1, 2, 3)} | {(rng.randrange(80), rng.randrange(80)) for _ in range(10)}
    df = spark.createDataFrame([(u + 1, v + 1) for u, v in pairs if u != v], "u long, v long")
    return graph.both_directions(graph.canonical_edges(df))


def _cut(arcs, colours):
    return sum(colours[a] != colours[b] for a, b in arcs) // 2


@pytest.mark.parametrize("policy,annealing", [("LOCAL", "LINEAR"), ("RANDOM", "LINEAR"), ("HYBRID", "LINEAR"), ("RANDOM", "EXPONENTIAL")])
def test_rounds(ring, policy, annealing):
    coloured, metrics = partition.jabeja(ring, rounds=3, delta=0.5, policy=policy, annealing=annealing, seed=1)
    rows, metrics = coloured.collect(), metrics.orderBy("round").collect()
    assert len(rows) == 80 and len(metrics) == 3
    count = lambda key: sorted(sum(r[key] == c for r in rows) for c in range(4))
    assert count("color") == count("init_color") == [20] * 4
    arcs = [(a.src, a.dst) for a in ring.collect()]
    assert metrics[-1].edge_cut == _cut(arcs, {r.vertex: r.color for r in rows})
    assert metrics[-1].migrations == sum(r.color != r.init_color for r in rows)
    assert [m.swaps for m in metrics] == sorted(m.swaps for m in metrics)


def test_cut_falls(ring):
    _, metrics = partition.jabeja(ring, rounds=16, delta=0.25, policy="RANDOM", seed=3)
    cuts = [m.edge_cut for m in metrics.orderBy("round").collect()]
    start = ring.count() // 2
    assert cuts[-1] < 0.75 * start


def test_cooling():
    assert partition.cool_linear(2.0, 0.5, 3) == [1.5, 1.0, 1.0]
    assert partition.cool_linear_late(1.25, 0.5, 3) == [0.75, 1.0, 1.0]
    assert partition.cool_linear_late(1.25, 0.5, 3, reset=True) == [0.75, 1.25, 0.75]
    assert partition.cool_exponential(3) == pytest.approx([0.99, 0.9801, 0.970299])
    assert partition.cool_exponential(800, reset=True)[-1] > 0.1


def test_config():
    assert partition.Config(policy="hybrid").policy == "HYBRID"
    for bad in ({"policy": "X"}, {"partitions": 0}, {"alpha": None}, {"temperature": 0}):
        with pytest.raises(ValueError):
            partition.Config(**bad)


def test_initial_colours(spark):
    ids = spark.range(1, 11)
    for policy, want in (("ROUND_ROBIN", [i % 4 for i in range(1, 11)]), ("BATCH", [next(c for c in range(4) if i <= (c + 1) * 10 / 4) for i in range(1, 11)])):
        assert [r[0] for r in ids.select(partition.initial_colour(F.col("id"), F.lit(10), 4, policy)).collect()] == want
    assert {r[0] for r in ids.select(partition.initial_colour(F.col("id"), F.lit(10), 4, "RANDOM", 3)).collect()} <= {0, 1, 2, 3}


def test_candidates(ring, spark):
    near = {}
    for a in ring.collect():
        near.setdefault(a.src, set()).add(a.dst)
    got = {}
    for r in partition.local_candidates(ring, 3, 0, 0).collect():
        got.setdefault(r.p, set()).add(r.q)
    assert all(got[p] <= near[p] and len(got[p]) == min(3, len(near[p])) for p in near)
    assert partition.local_candidates(ring, 0, 0, 0).count() == 0
    many = partition.global_candidates(spark.range(1, 6), 5, 9, 0, 0).collect()
    assert all(r.p != r.q and 1 <= r.q <= 5 for r in many) and len({(r.p, r.q) for r in many}) == len(many)


def test_external_partition(spark, ring):
    parts = spark.range(1, 81).select("id", (F.col("id") % 2).alias("part"))
    arcs = [(a.src, a.dst) for a in ring.collect()]
    got = partition.partition_report(ring, parts).first()
    assert (got.edge_cut, got.migrations) == (_cut(arcs, {i: i % 2 for i in range(1, 81)}), 0)
