"""Formatting duplicates and fixed-size samples."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from orewright.llm import format_duplicates as fd
from orewright.llm import reservoir

LINES = [
    (1, "10 20 cites"), (2, "20,10 CITES"), (3, ' "10","20","ci tes". '), (4, "10 20 signs"), (5, "% 10 20 cites"), (6, "  \xa0% 10 20 cites"), (7, "10 20"),
    (8, "10 cites"), (9, "10 20 30 cites"), (10, ""), (11, None), (12, "cites(20,10)"), (13, "010 20 cites"), (14, "1020 cites"), (15, "10a20"), (16, "a10 20"),
    (17, "10 10 cites"), (18, "10 20 cités"), (None, "10 20 cites"), (19, "９ 10 20 cites"), (20, "0 00 x"), (21, "00 0 X"),
]


def _lines(spark, rows, parts=3):
    extra = "line_id long, line string, id int, hash int, maybe string, low int, kind int, first_id int"
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5) for r in rows], extra).repartition(parts)


def test_records(spark):
    records, repeats = fd.collapse(fd.edge_records(_lines(spark, LINES)), ["low", "high", "kind"])
    got = {(r.low, r.high, r.kind): (r.first_id, r.copies) for r in records.collect()}
    assert got == {
        ("10", "20", "cites"): (1, 6), ("10", "20", "signs"): (4, 1), ("10", "20", "a"): (15, 2), ("10", "10", "cites"): (17, 1), ("10", "20", "cités"): (18, 1), ("0", "0", "x"): (20, 2),
    }
    assert sorted(map(tuple, repeats.collect())) == [(1, 2), (1, 3), (1, 12), (1, 13), (1, 19), (15, 16), (20, 21)]


@pytest.mark.parametrize("bits,most", [(8, 1 << 28), (1, 1 << 28), (8, 1 << 13), (8, 64)])
def test_filter_changes_no_result(spark, bits, most):
    """Small and hence full filters, several rounds, and the way without a filter give the same groups."""
    rng = random.Random(1)
    rows = [(i, f"{rng.randrange(60)} {rng.randrange(60)} k") for i in range(3000)] + [(3000 + i, "7 8 hot") for i in range(1500)]
    groups = defaultdict(list)
    for i, line in rows:
        a, b, kind = line.split()
        groups[min(a, b), max(a, b), kind].append(i)
    records, repeats = fd.collapse(fd.edge_records(_lines(spark, rows, 6)), ["low", "high", "kind"], len(rows), bits, most)
    assert {(r.low, r.high, r.kind): (r.first_id, r.copies) for r in records.collect()} == {k: (min(v), len(v)) for k, v in groups.items()}
    assert sorted(map(tuple, repeats.collect())) == sorted((min(v), i) for v in groups.values() for i in v if i != min(v))


def test_merged_filters_know_every_repeat():
    rng = np.random.default_rng(2)
    once, twice = rng.integers(-(2**63), 2**63, 4000), rng.integers(-(2**63), 2**63, 500)
    keys = np.concatenate((once, twice, twice))
    rng.shuffle(keys)
    merged = None
    for part in np.array_split(keys, 7):
        seen = fd.SeenTwice(1 << 16)
        for batch in np.array_split(part, 3):
            seen.add(batch)
        merged = (seen.once, seen.twice) if merged is None else (merged[0] | seen.once, merged[1] | seen.twice | (merged[0] & seen.once))
    assert fd.maybe_repeated(merged[1], twice).all()
    assert fd.maybe_repeated(merged[1], once).mean() < 0.02


def test_many_rounds_still_filter(spark):
    rng = random.Random(4)
    once, twice = ([rng.randrange(-(2**63), 2**63) for _ in range(n)] for n in (12_000, 300))
    rows = spark.createDataFrame([(h,) for h in once + twice + twice], "hash long").repartition(3)
    alone = Counter(r.hash for r in fd.possible_repeats(rows, "hash long", 12_600, 8, fd.LEAST_BITS, only=True).collect())
    assert all(alone[h] == 2 for h in twice) and len(alone) < 2_000
    got = fd.possible_repeats(rows, "hash long", 12_600, 8, fd.LEAST_BITS).collect()
    assert len(got) == 12_600
    maybe = Counter(r.hash for r in got if r.maybe)
    assert all(maybe[h] == 2 for h in twice) and len(maybe) < 2_000


def test_no_lines(spark):
    for rows in ([], [(1, None)], [(1, "%")]):
        records, repeats = fd.collapse(fd.edge_records(_lines(spark, rows)), ["low", "high", "kind"])
        assert records.count() == repeats.count() == 0


def test_very_long_line(spark):
    rows = [(1, "1" * 50_000 + " 2 " + "k" * 200_000), (2, "2;" + "1" * 50_000 + "K" * 200_000)]
    assert [tuple(r) for r in fd.collapse(fd.edge_records(_lines(spark, rows)), ["low", "high", "kind"])[1].collect()] == [(1, 2)]


@pytest.mark.parametrize("n,m", [(0, 5), (3, 5), (5, 5), (400, 5), (400, 399)])
def test_sample_size(spark, n, m):
    df = spark.createDataFrame([(i, None if i % 3 else "x", i, i) for i in range(n)], "place int, row string, reservoir int, population int").repartition(5)
    rows = [tuple(r) for r in reservoir.sample(df, m, 1).collect()]
    assert len(rows) == min(n, m) == len(set(rows)) and set(rows) <= {tuple(r) for r in df.collect()}


def test_sample_is_uniform(spark):
    df = spark.range(0, 40, 1, 4).coalesce(4)
    counts = Counter()
    for seed in range(120):
        counts.update(r.id for r in reservoir.sample(df, 10, seed).collect())
    chi = sum((counts[i] - 30) ** 2 / 30 for i in range(40))
    assert chi < 39 + 4 * (2 * 39) ** 0.5


@pytest.mark.parametrize("n", [3, 40])
def test_merged_reservoirs_are_uniform(spark, n):
    df, counts = spark.range(0, n, 1, 9), Counter()
    for seed in range(60):
        states = reservoir.merge_reservoirs(reservoir.reservoirs(df, 10, seed), 10, seed, fan=3)
        if seed == 0:
            assert states.select("reservoir").distinct().count() <= 3 and states.groupBy("reservoir").count().filter("count > 10").isEmpty()
        counts.update(r.id for r in reservoir.draw(states, 10, seed).collect())
    assert sum(counts.values()) == 60 * min(n, 10)
    expected = 60 * min(n, 10) / n
    assert sum((counts[i] - expected) ** 2 / expected for i in range(n)) < n - 1 + 4 * (2 * (n - 1)) ** 0.5


def test_skips_are_uniform():
    rng = np.random.default_rng(3)
    counts = np.zeros(50)
    for _ in range(4000):
        skips, held, start = reservoir.Skips(5, rng), {}, 0
        for n in (3, 1, 20, 26):
            at, slots = skips.within(start, n)
            held |= {s: start + a for a, s in zip(at, slots)}
            start += n
        assert len(held) == 5
        counts[list(held.values())] += 1
    assert ((counts - 400) ** 2 / 400).sum() < 49 + 4 * 98**0.5


def test_pieces_can_be_joined(spark):
    states = [reservoir.reservoirs(spark.range(a, b, 1, 2), 20, s) for s, (a, b) in enumerate([(0, 30), (30, 33), (33, 500)])]
    rows = [r.id for r in reservoir.draw(reservoir.union_states(states), 20, 9).collect()]
    assert len(rows) == len(set(rows)) == 20 and max(rows) < 500
    with pytest.raises(ValueError):
        reservoir.reservoirs(spark.range(3), 0, 1)


def test_repeated_rows_are_rows(spark):
    df = spark.createDataFrame([(None, 1)] * 50, "a string, b int").repartition(3)
    assert reservoir.sample(df, 20, 1).count() == 20
