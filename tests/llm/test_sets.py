"""Top items, co-occurrence and set similarity against brute force."""

import itertools
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from orewright.llm import cooccurrence, set_join, sets, top_items


def _frame(spark, rows, parts=4):
    extra = "b long, s array<int>, id string, items int, n int, key int, h1 int, node int"
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], extra).repartition(parts)


def _sets(rows):
    out = {}
    for i, items in rows:
        held = {x for x in items or [] if x is not None}
        if i is not None and held:
            out[i] = out.get(i, set()) | held
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(400):
        out.append((i, [min(int(rng.paretovariate(0.6)), 2**31 - 1) * rng.choice([1, -1]) for _ in range(rng.randrange(0, 12))]))
    for i in range(400, 520):
        base = [x for x in out[rng.randrange(400)][1] for _ in range(1)]
        out.append((i, base[: len(base) - rng.randrange(2)] + [rng.randrange(50)] * rng.randrange(2)))
    hot = out[5]
    out += [(hot[0], hot[1][::-1])] * 200 + [(None, [1, 2]), (900, None), (901, []), (902, [None]), (903, [None, 2**31 - 1, -(2**31)]), (904, [-(2**31), 2**31 - 1])]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("k", [1, 7, 40, 10_000])
@pytest.mark.parametrize("nodes", [1, 5])
def test_top_items(spark, rows, k, nodes):
    counts = Counter(x for s in _sets(rows).values() for x in s)
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
    assert [tuple(r) for r in top_items.top_items(_frame(spark, rows), "b", "s", k, nodes).collect()] == want


def test_top_items_with_equal_counts(spark):
    rows = [(i, [i % 10]) for i in range(100)]
    assert [tuple(r) for r in top_items.top_items(_frame(spark, rows), "b", "s", 3).collect()] == [(0, 10), (1, 10), (2, 10)]


@pytest.mark.parametrize("block", [2, 3, 64])
@pytest.mark.parametrize("share,lift", [("0.005", 3), ("0.0001", 1), ("0.05", 1), ("0.5", 0)])
def test_associations(spark, rows, block, share, lift):
    held = _sets(rows)
    single = Counter(x for s in held.values() for x in s)
    pairs = Counter(p for s in held.values() for p in itertools.combinations(sorted(s), 2))
    n = len(held)
    want = {(a, b, c, single[a], single[b], n) for (a, b), c in pairs.items() if c >= Fraction(share) * n and c * n >= lift * single[a] * single[b]}
    got = {tuple(r)[:6] for r in cooccurrence.associated_pairs(_frame(spark, rows), "b", "s", share, lift, block).collect()}
    assert got == want


def test_all_pairs(spark, rows):
    held = _sets(rows)
    single = Counter(x for s in held.values() for x in s)
    pairs = Counter(p for s in held.values() for p in itertools.combinations(sorted(s), 2))
    got = {tuple(r) for r in cooccurrence.associated_pairs(_frame(spark, rows), "b", "s", "0", 0).collect()}
    assert got == {(a, b, c, single[a], single[b], len(held), c * len(held) / (single[a] * single[b])) for (a, b), c in pairs.items()}


def test_huge_basket(spark):
    rows = [(1, list(range(500))), (2, list(range(400, 700)))]
    _, pairs = cooccurrence.pair_counts(sets.one_set_each(_frame(spark, rows), "b", "s"), 1, 64)
    counts = Counter({(r.item_a, r.item_b): r.n for r in pairs.collect()})
    want = Counter(p for _, s in rows for p in itertools.combinations(s, 2))
    assert counts == want


def test_partial_sums_stay_bounded(monkeypatch):
    monkeypatch.setattr(cooccurrence, "HELD", 50)
    rng = np.random.default_rng(1)
    sums, out = cooccurrence._Sums(), Counter()
    keys = rng.integers(0, 300, 4000)
    for part in np.array_split(keys, 100):
        sums.add((part << 32) | (part + 1 + 2**31))
        if sums.full():
            for batch in sums.flush():
                out.update(dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())))
        assert sums.size <= 90
    for batch in sums.flush():
        out.update(dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())))
    assert out == Counter(keys.tolist())


def _similar(rows, t):
    held = _sets(rows)
    return {(a, b) for a, b in itertools.combinations(sorted(held), 2) if len(held[a] & held[b]) >= t * len(held[a] | held[b])}


@pytest.mark.parametrize("threshold,limits", [("0.8", (64, 4096)), ("0.8", (2, 4)), ("0.8", (0, 0)), ("0.5", (64, 4096)), ("0.9", (3, 1000))])
def test_similar_sets(spark, rows, threshold, limits):
    """Also with limits at which every key needs two or three tokens."""
    members, links = set_join.similar_sets(_frame(spark, rows), "b", "s", threshold, limits)
    got = set_join.equal_pairs(members).unionByName(set_join.linked_pairs(members, links)).distinct()
    assert {tuple(r) for r in got.collect()} == _similar(rows, Fraction(threshold))


def test_similar_large_sets(spark):
    rng = random.Random(3)
    common = [rng.randrange(-(2**31), 2**31) for _ in range(60)]
    rows = []
    for g in range(25):
        base = [rng.randrange(-(2**31), 2**31) for _ in range(rng.randrange(30, 200))] + common * (g % 2)
        for c in range(4):
            rows.append((g * 10 + c, [x for x in base if rng.random() > 0.04 * c] + [rng.randrange(1000) for _ in range(c)]))
    rows += [(1000, rows[0][1] + [None]), (1001, rows[0][1][::-1])]
    got = {tuple(r) for r in set_join.similar_id_pairs(_frame(spark, rows), "b", "s").collect()}
    assert got == _similar(rows, Fraction(4, 5)) and len(got) > 40


def test_classes(spark, rows):
    held = _sets(rows)
    found = set_join.similar_set_classes(_frame(spark, rows), "b", "s").collect()
    assert {r.id for r in found} == set(held) and len(found) == len(held)
    by = {r.id: r for r in found}
    for i, s in held.items():
        same = [j for j in held if held[j] == s]
        near = {frozenset(held[j]) for j in held if held[j] != s and len(held[j] & s) * 5 >= 4 * len(held[j] | s)}
        assert (by[i]["class"], by[i].copies, by[i].links) == (min(same), len(same), len(near))


def test_an_id_with_two_sets_is_in_both(spark):
    rows = [(1, [1, 2, 3]), (1, [7, 8, 9]), (2, [3, 2, 1]), (3, [9, 8, 7]), (4, [5])]
    assert {tuple(r) for r in set_join.similar_id_pairs(_frame(spark, rows), "b", "s").collect()} == {(1, 2), (1, 3)}


@pytest.mark.parametrize("rows", [[], [(1, None), (2, []), (3, [None]), (None, [1])]])
def test_nothing(spark, rows):
    df = _frame(spark, rows)
    assert top_items.top_items(df, "b", "s", 5).count() == 0
    assert cooccurrence.associated_pairs(df, "b", "s").count() == 0
    assert set_join.similar_id_pairs(df, "b", "s").count() == 0
    assert set_join.similar_set_classes(df, "b", "s").count() == 0


def test_many_equal_sets(spark):
    rows = [(i, [1, 2, 3, 4, 5]) for i in range(120)] + [(500, [1, 2, 3, 4, 5, 6])]
    assert set_join.similar_id_pairs(_frame(spark, rows), "b", "s").count() == 120 * 119 // 2 + 120


def _pairs_by_force(sets, t):
    return {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and len(a & b) >= t * len(a | b)}


@pytest.mark.parametrize("budget", [20, 2_000])
def test_key_budget_loses_no_pair(spark, budget):
    """Sets on both sides of the sizes from which fewer tokens are combined."""
    rng = random.Random(budget)
    sets = []
    for n in (4, 9, 20, 40, 90, 100, 110, 290, 310, 330):
        base = rng.sample(range(400), n)
        for k in range(4):
            sets.append(set(rng.sample(base, n - k * n // 12)) | set(rng.sample(range(400), k * n // 20)))
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "id long, s array<int>").repartition(3)
    members, links = set_join.similar_sets(df, "id", "s", "0.8", (1, 2), budget)
    found = {tuple(r) for r in set_join.equal_pairs(members).unionByName(set_join.linked_pairs(members, links)).collect()}
    assert found == _pairs_by_force(sets, 0.8) and len(found) > 10


def test_keys_of_large_sets_are_few():
    for n in (50, 100, 101, 300, 306, 800, 5_000):
        items, counts = np.arange(n), np.full(n, 10_000)
        at, keys = set_join.prefix_keys(np.zeros(n, np.int64), items, counts, Fraction(4, 5))
        assert 0 < len(keys) <= 2 * set_join.KEY_BUDGET + n
