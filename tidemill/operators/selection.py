"""Exact choices and orders of many rows without sorting them: the first n by a hash, and seeded permutations of row numbers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.quota import ranked_within

#: Digits of the hash that one round of counting tells apart, and rows up to which a plain ordered limit does.
DIGITS, FEW = 4, 1_000
#: Rounds of a permutation, and the prime and the offsets' size that its round function works with.
ROUNDS, PRIME, OFFSETS = 8, 2_147_483_647, 1 << 29


def mixed(seed: int, *key: str) -> Column:
    """md5 of the seed and the key as hexadecimal digits, which other engines can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))


def border(hashes: DataFrame, n: int) -> tuple[str, int, bool] | None:
    """Where the n-th of the hashes ``h`` lies: how it begins, how many of those that begin so belong to the first n, and whether all do. None if there are no more than n.

    Each round counts by some more digits, below the beginning that is known;
    no round gathers more than a count for each value of these digits.
    """
    begins, left = "", n
    while True:
        size = len(begins) + DIGITS
        counts = hashes.where(F.col("h").startswith(begins)).groupBy(F.substring("h", 1, size).alias("d")).count().collect()
        for d, some in sorted(map(tuple, counts)):
            if left <= some:
                break
            left -= some
        else:
            return None
        if left == some or size >= 32:
            return d, left, left == some
        begins = d


def first_by_hash(rows: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by md5(seed, key), rows of one key in the order of the key's columns and then of no certain order.

    The hash of the n-th row is found by counting, so that choosing is a
    filter. The rows are read once more for each round of counting, and must be
    the same each time.
    """
    if n <= 0:
        return rows.limit(0)
    hashed = rows.withColumn("__h", mixed(seed, *key))
    if n <= FEW:
        return hashed.orderBy("__h", *key).limit(n).drop("__h")
    found = border(hashed.select(F.col("__h").alias("h")), n)
    if found is None:
        return rows
    begins, left, all_ = found
    at = F.substring("__h", 1, len(begins))
    if all_:
        return hashed.where(at <= begins).drop("__h")
    # rows of one hash: no more digits tell them apart
    alike = ranked_within(hashed.where(at == begins).withColumn("__one", F.lit(1)), "__one", list(key), "__r").where(F.col("__r") <= left)
    return hashed.where(at < begins).unionByName(alike.drop("__one", "__r")).drop("__h")


def _offset(seed: int, k: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}|{k}".encode()).digest()[:8], "big") % OFFSETS


def _walk(index: Column, n: int, seed: int, rounds: Sequence[int], sign: int) -> Column:
    a = math.isqrt(max(0, n - 1)) + 1
    b = -(-n // a) or 1
    offsets = F.array(*(F.lit(_offset(seed, k)).cast("long") for k in range(ROUNDS)))

    def once(x: Column) -> Column:
        def step(now: Column, k: Column) -> Column:
            high, low = F.call_function("div", now, F.lit(b)), now % b
            added = lambda v, size: F.pmod((v + offsets[k]) * (v + offsets[k]) % PRIME % size * sign, F.lit(size).cast("long"))
            return F.when(k % 2 == 0, (high + added(low, a)) % a * b + low).otherwise(high * b + (low + added(high, b)) % b).cast("long")

        return F.aggregate(F.array(*map(F.lit, rounds)), x, step)

    # beyond n the permutation of 0..a*b-1 is followed until it comes back; that takes a * b - n steps at most
    back = min(a * b - n, 64)
    first = once(index.cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(back)), first, lambda x, _: F.when(x < n, x).otherwise(once(x))) if back else first


def permuted(index: Column, n: int, seed: int) -> Column:
    """The place of a row number, from 0 to n - 1, in a seeded permutation: a keyed bijection in balanced rounds, worked out row by row.

    Numbers are split into two digits, of about the root of n each; every
    round adds to one digit a function of the other, which can be taken back.
    ``n`` is below 2**62.
    """
    return _walk(index, n, seed, range(ROUNDS), 1)


def unpermuted(place: Column, n: int, seed: int) -> Column:
    """The row number that has this place: the inverse of ``permuted``."""
    return _walk(place, n, seed, range(ROUNDS)[::-1], -1)
