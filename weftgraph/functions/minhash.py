"""MinHash signatures of id lists as expressions, and an order that puts like lists side by side."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    """Deterministic Miller-Rabin below 3.3e24."""
    if n < 2:
        return False
    small = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    if any(n % p == 0 for p in small):
        return n in small
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in small:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def signature(ids: Column, dimensions: int, universe: int, seed: int = 42) -> Column:
    """array<bigint>: for each dimension the least (a * id + b) mod p, with p a prime in [universe, 2 universe)."""
    rng = random.Random(seed)
    prime = next(n for n in range(max(universe, 3), 2 * max(universe, 3)) if is_prime(n))
    if prime >= 1 << 31:
        raise ValueError("the universe must be below 2**31, so that products fit a bigint")
    pairs = [(rng.randrange(1, prime), rng.randrange(prime)) for _ in range(dimensions)]

    def least(a: int, b: int) -> Column:
        return F.array_min(F.transform(ids, lambda x: F.pmod(F.pmod(x, F.lit(prime)) * a + b, F.lit(prime))))

    return F.array(*[least(a, b) for a, b in pairs])


def like_side_by_side(lists: DataFrame, ids: str, dimensions: int = 4, universe: int = 1 << 30) -> DataFrame:
    """lists range-partitioned and sorted by signature, so that rows that share ids meet in a task."""
    signed = lists.withColumn("signature", signature(F.col(ids), dimensions, universe))
    return signed.repartitionByRange("signature").sortWithinPartitions("signature")
