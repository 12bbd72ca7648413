import itertools
import random

import numpy as np
import pytest

from orewright.operators import patterns


def _brute(baskets, least):
    out = {}
    items = sorted({i for b in baskets for i in b})
    for size in range(1, len(items) + 1):
        level = {c: n for c in itertools.combinations(items, size) if (n := sum(set(c) <= b for b in baskets)) >= least and n}
        if not level:
            break
        out |= level
    return out


@pytest.fixture(scope="module")
def baskets(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1, 1, 2, 2, 3, 4, 5, 6]) for _ in range(rng.randrange(0, 6))]) for i in range(60)]
    rows += [(3, rows[3][1][::-1]), (None, [1, 2]), (99, None), (98, []), (97, [None, 2])]
    return spark.createDataFrame(rows, "basket_id long, items array<int>"), rows


@pytest.mark.parametrize("method", ["apriori", "fpgrowth"])
@pytest.mark.parametrize("support", [0.0, 0.1, 0.4, 1.1])
def test_itemsets(baskets, method, support):
    df, rows = baskets
    sets = {}
    for i, items in rows:
        if i is not None:
            sets.setdefault(i, set()).update(x for x in items or [] if x is not None)
    held = [s for s in sets.values() if s]
    found = patterns.find_frequent_items(patterns.distinct_baskets(df, "basket_id", "items"), support, method=method)
    assert {tuple(r["items"]): r["freq"] for r in found.collect()} == _brute(held, support * len(held))


def test_candidates_in_several_passes(baskets, monkeypatch):
    df, _ = baskets
    monkeypatch.setattr(patterns, "STATES", 5)
    long = patterns.distinct_baskets(df, "basket_id", "items")
    few, all_ = (patterns.find_frequent_items(long, 0.05, most=most) for most in (3, 1_000_000))
    assert sorted((tuple(r["items"]), r["freq"]) for r in few.collect()) == sorted((tuple(r["items"]), r["freq"]) for r in all_.collect())


def test_later_places_in_slices(monkeypatch):
    monkeypatch.setattr(patterns, "STATES", 4)
    ends = np.array([4, 4, 4, 4, 7, 7, 7])
    got = [(i, p) for index, place in patterns._later(ends, np.array([0, 2, 3, 4, 6])) for i, p in zip(index.tolist(), place.tolist())]
    assert got == [(0, 1), (0, 2), (0, 3), (1, 3), (3, 5), (3, 6)]


def test_rules(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2, 3]), (3, [1, 2]), (4, [3])], "basket_id int, items array<int>")
    itemsets = patterns.find_frequent_items(patterns.distinct_baskets(rows, "basket_id", "items"), 0.5)
    assert {tuple(r["items"]): r["freq"] for r in itemsets.collect()} == {(1,): 3, (2,): 3, (3,): 3, (1, 2): 3, (1, 3): 2, (2, 3): 2, (1, 2, 3): 2}
    rules = patterns.get_rules(itemsets, 0.5).collect()
    assert len(rules) == 12 and (([3], [1, 2])) in [(r.antecedent, r.consequent) for r in rules]
    counts = {tuple(r["items"]): r["freq"] for r in itemsets.collect()}
    for r in rules:
        assert r.confidence == pytest.approx(counts[tuple(sorted(r.antecedent + r.consequent))] / counts[tuple(r.antecedent)])
    assert patterns.get_rules(itemsets, 1.0).filter("confidence < 1").count() == 0


def test_empty(spark):
    rows = spark.createDataFrame([], "basket_id long, items array<int>")
    found = patterns.find_frequent_items(patterns.distinct_baskets(rows, "basket_id", "items"), 0.5)
    assert found.count() == 0 and patterns.get_rules(found, 0.5).count() == 0
