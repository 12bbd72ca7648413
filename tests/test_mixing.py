import numpy as np
import pytest

from orewright.functions.mixing import hashed_counts, slot


@pytest.mark.parametrize("slots", [1 << 10, 1 << 16, 1 << 19])
def test_hashed_counts(spark, slots):
    rng = np.random.default_rng(1)
    lists = [rng.integers(-(2**31), 2**31, n).tolist() for n in rng.integers(0, 50, 400)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id long, items array<int>").repartition(3)
    want = np.bincount(slot(np.concatenate(lists).astype(np.int64), slots), minlength=slots)
    assert np.array_equal(hashed_counts(df, slots), want)
