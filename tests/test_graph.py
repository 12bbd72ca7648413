import itertools
import random

import pytest

from orewright.operators import components, graph, triest
from orewright.streaming import triest_stream


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(25), rng.randrange(25)) for i in range(220)]
    rows += [(300 + i, 0, v) for i, v in enumerate(range(1, 25))] + [(400, None, 3), (401, 3, None), (402, 5, 5)]
    df = spark.createDataFrame(rows, "seq long, u long, v long")
    first = {}
    for seq, u, v in rows:
        if u is not None and v is not None and u != v:
            first.setdefault((min(u, v), max(u, v)), seq)
    return graph.canonical_edges(df, seq="seq"), [e for e, _ in sorted(first.items(), key=lambda x: x[1])]


def _triangles(pairs):
    known = set(pairs)
    vertices = sorted({x for e in pairs for x in e})
    return {t for t in itertools.combinations(vertices, 3) if all(e in known for e in itertools.combinations(t, 2))}


def test_triangles(edges):
    df, pairs = edges
    assert {(r.u, r.v) for r in df.collect()} == set(pairs)
    want = _triangles(pairs)
    assert {(r.a, r.b, r.c) for r in graph.triangles(df).collect()} == want and graph.triangles(df).count() == len(want)
    per = {r.vertex: r.triangles for r in graph.triangles_per_vertex(df).collect()}
    assert per == {v: sum(v in t for t in want) for v in {x for e in pairs for x in e}}


@pytest.mark.parametrize("partial", [False, True])
def test_windows(edges, partial):
    df, pairs = edges
    got = {r.window_id: (r.n, r.estimate) for r in graph.triangle_count_windows(df, 20, partial).collect()}
    want = {w: (min(20, len(pairs) - 20 * w), float(len(_triangles(pairs[: 20 * w + 20])))) for w in range(-(-len(pairs) // 20))}
    assert got == {w: x for w, x in want.items() if partial or x[0] == 20}


def test_base_sample(edges):
    df, pairs = edges
    assert triest.triest_base(df, 10_000, 1).first().estimate == len(_triangles(pairs))
    got = triest.triest_base(df, 60, 1).first()
    assert (got.t, got.sampled) == (len(pairs), 60) and got.estimate >= got.triangles
    with pytest.raises(ValueError):
        triest.triest_base(df, 2, 1)


@pytest.mark.parametrize("method", ["base", "IMPR"])
def test_stream(spark, edges, method, tmp_path):
    df, pairs = edges
    df.coalesce(1).orderBy("seq").write.parquet(f"{tmp_path}/in")
    stream = triest_stream.triest_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 5000, method)
    out = triest_stream.run_to_table(stream, str(tmp_path))
    got = {r.position: r.estimate for r in out.collect()}
    assert got == {i + 1: float(len(_triangles(pairs[: i + 1]))) for i in range(len(pairs))}
    windows = triest_stream.count_windows(out, 20).orderBy("window_id").collect()
    assert len(windows) == len(pairs) // 20 and windows[-1].estimate == got[20 * len(windows)]


@pytest.mark.parametrize("improved", [True, False])
def test_reservoir_is_near_the_truth(improved):
    rng = random.Random(5)
    pairs = list({(min(e), max(e)) for e in ((rng.randrange(60), rng.randrange(60)) for _ in range(3000)) if e[0] != e[1]})
    rng.shuffle(pairs)
    truth = len(_triangles(pairs))
    estimates = []
    for seed in range(20):
        sample = triest_stream.Reservoir(len(pairs) // 3, improved, seed)
        for u, v in pairs:
            last = sample.add(u, v)
        assert len(sample.edges) == len(pairs) // 3
        if not improved:
            assert sample.tau == len(_triangles(sample.edges))
        estimates.append(last)
    assert sum(estimates) / 20 == pytest.approx(truth, rel=0.15)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (200, 200), (None, 3)]
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
