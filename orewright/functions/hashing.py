"""Hash columns that give the same values in other engines, and a seeded family of linear hashes."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The modulus of the linear family, a prime.
MODULUS = 2_147_483_647


def md5_int(text: Column) -> Column:
    """The first 32 bits of the md5, as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def int31(text: Column, method: str = "xxhash") -> Column:
    """A value in [0, MODULUS): ``xxhash`` is fast, ``md5`` is the same in every engine."""
    if method == "md5":
        return md5_int(text) % MODULUS
    if method != "xxhash":
        raise ValueError("method is 'xxhash' or 'md5'")
    return F.pmod(F.xxhash64(text), F.lit(MODULUS))


def string_hash(text: Column) -> Column:
    """The 32-bit polynomial hash of base 31 over code points, signed, as the JVM has it for strings within the BMP."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    wrapped = F.aggregate(points, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    return F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped).cast("int")


def linear_family(n: int, seed: int) -> list[tuple[int, int]]:
    """``n`` pairs (a, b) with 1 <= a, b < 2^30, so that a * x + b never overflows a BIGINT for x below MODULUS."""
    rng = random.Random(seed)
    return [(rng.randrange(1, 1 << 30), rng.randrange(1, 1 << 30)) for _ in range(n)]


def sequence_hash(values: Column, buckets: int | None = None, method: str = "xxhash") -> Column:
    """A hash of an array in its order, of 64 bits or (``md5``, the same in every engine) 32; with ``buckets`` a number in [0, buckets)."""
    joined = F.concat_ws(",", F.transform(values, lambda x: x.cast("string")))
    whole = md5_int(joined) if method == "md5" else F.xxhash64(joined)
    return F.pmod(whole, F.lit(buckets)) if buckets else whole
