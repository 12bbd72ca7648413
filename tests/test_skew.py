import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orewright.operators import blocks, skew


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    edges = [(rng.choice([1, 1, 1, 2, rng.randrange(300)]), rng.randrange(300)) for _ in range(3000)] + [(None, 1), (1, None), (None, None), (7, 7), (7, 7)]
    links = [(rng.choice([5, 5, rng.randrange(100)]), rng.choice([None, rng.randrange(100)])) for _ in range(800)] + [(None, 2)]
    extra = "u long, v long, origin string, vertex int, chunk int, rows int"
    e = spark.createDataFrame([(u, v, "x", 1, 2, 3) for u, v in edges], extra).repartition(5)
    return e, spark.createDataFrame(links, "src int, dst int").repartition(3), edges, links


def _ends(edges, links):
    out = []
    for u, v in edges:
        if u is not None:
            out.append(("edges", u, v))
        if v is not None and u != v:
            out.append(("edges", v, u))
    return out + [("graph_links", s, d) for s, d in links if s is not None]


@pytest.mark.parametrize("limit", [0, 200_000])
@pytest.mark.parametrize("chunk", [50, 50_000])
def test_hot_vertices(tables, chunk, limit, monkeypatch):
    monkeypatch.setattr(skew, "MAX_BROADCAST_OFFSETS", limit)
    e, l, edges, links = tables
    rows = Counter((o, x) for o, x, _ in _ends(edges, links))
    got = {(r.origin, r.vertex): r["rows"] for r in skew.hot_vertices(e, l, 100, chunk).collect()}
    assert got == {k: n for k, n in rows.items() if n * 100 >= (len(edges) if k[0] == "edges" else len(links))}


@pytest.mark.parametrize("chunk", [20, 50_000])
def test_neighbours(tables, chunk):
    e, l, edges, links = tables
    near = defaultdict(set)
    for o, x, y in _ends(edges, links):
        near[o, x] |= {y} - {None, x}
    got = defaultdict(list)
    for r in skew.neighbour_lists(e, l, chunk).orderBy("chunk").collect():
        assert len(r.neighbours) <= chunk and r.first_row == len(got[r.origin, r.vertex])
        got[r.origin, r.vertex] += r.neighbours
    assert got == {k: sorted(v) for k, v in near.items() if v}
    rows = Counter((o, x) for o, x, _ in _ends(edges, links))
    degrees = {(r.origin, r.vertex): (r["rows"], r.neighbours) for r in skew.vertex_degrees(e, l, chunk).collect()}
    assert degrees == {k: (n, len(near[k])) for k, n in rows.items()}


def test_number_rows(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)] + [(None, i) for i in range(30)] + [("b", 0)], "k string, x int").repartition(6)
    rows = skew.number_rows(df, ["k"], 8).collect()
    for key, n in (("a", 100), (None, 30), ("b", 1)):
        own = [r for r in rows if r.k == key]
        assert sorted(r.key_row for r in own) == list(range(n)) and all(r.chunk == r.key_row // 8 for r in own)
        assert sorted(r.x for r in own) == list(range(n))


def test_keys_of_any_type_stay_apart(spark):
    big = 2**53
    df = spark.createDataFrame([(big, "x"), (big + 1, "x"), (None, "x"), (big, None), (big, "x"), (None, None)] * 40, "k long, s string").repartition(5)
    got = {(r.k, r.s): (r["rows"], r.chunks) for r in skew.key_rows(df, ["k", "s"], 16).collect()}
    assert got == {(big, "x"): (80, 5), (big + 1, "x"): (40, 3), (None, "x"): (40, 3), (big, None): (40, 3), (None, None): (40, 3)}
    assert {(r.k, r["rows"]) for r in skew.key_rows(df, ["k"], 16).collect()} == {(big, 120), (big + 1, 40), (None, 80)}


def test_running_sums(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5) for i in random.Random(2).sample(range(300), 300)], "x int, n int").repartition(4)
    total, want = 0, {}
    for i in range(300):
        total += 0 if i % 7 == 0 else i % 5
        want[i] = total
    assert {r.x: r.s for r in skew.running_sums(df, ["x"], "s", F.col("n")).collect()} == want


def test_empty(spark):
    e, l = spark.createDataFrame([], "u long, v long"), spark.createDataFrame([], "src int, dst int")
    assert skew.hot_vertices(e, l).count() == skew.vertex_degrees(e, l).count() == skew.neighbour_lists(e, l).count() == 0


def test_broken_chunks_are_an_error(spark):
    states = spark.createDataFrame([("a", 0, 5, 0, 4), ("a", 1, 5, 6, 10)], "k string, chunk long, rows long, first_row long, last_row long")
    with pytest.raises(Exception, match="don't join"):
        skew.merge_states(states, ["k"], ["rows"]).collect()


def test_index_rows(spark):
    values = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "x int").repartition(7)
    assert {r.x: r.position for r in skew.index_rows(df, ["x"]).collect()} == {v: i + 1 for i, v in enumerate(sorted(values))}


@pytest.mark.parametrize("most", [1, 200_000])
def test_join_totals(spark, most):
    rows = spark.createDataFrame([(i % 3 if i < 90 else i, i) for i in range(120)], "k int, x int")
    totals = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, skew.join_totals(rows, totals, ["k"], "n", many=10, most=most).collect())) == sorted(map(tuple, rows.join(totals, ["k"]).collect()))


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_block_pairs(spark, block):
    members = [("x", i) for i in range(40)] + [("y", 1), ("y", 2), ("z", 1)]
    df = spark.createDataFrame(members, "k string, i int")
    got = blocks.block_pairs(df, ["k"], F.col("i"), F.abs(F.col("a.i") - F.col("b.i")) < 9, {"k": F.col("a.k"), "a": F.least("a.i", "b.i"), "b": F.greatest("a.i", "b.i")}, block)
    want = sorted((k, i, j) for k, i in members for m, j in members if k == m and i < j < i + 9)
    assert sorted(map(tuple, got.collect())) == want
