"""Length-balanced partitions of batches by the largest differencing method, and greedily.

A batch of more rows than one task should order is balanced in two levels: each
shard of it on its own, then the shards' lists as one step of differencing
merges them, heaviest to lightest. That merge leaves sums no further apart than
in the shard where they are furthest apart, which is at most the longest row:
the same bound as in one level.
"""

from __future__ import annotations

import heapq
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.quota import ranked_within
from tidemill.storage import shared_folder, written_down

#: Rows of one shard; a batch of no more is balanced in one level.
SHARD = 65_536


def largest_differencing(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """k lists of row numbers with near-equal sums; of equal size on demand, for which k must go into the number of rows.

    The two partial solutions that spread most are joined, heaviest list to
    lightest, until one is left.
    """
    if equal_size and len(lengths) % k:
        raise ValueError(f"{len(lengths)} rows can't be dealt into {k} lists of equal size")
    ordered = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    ticket, heap = count(), []
    for at in range(0, len(ordered), k if equal_size else 1):
        own = ordered[at : at + (k if equal_size else 1)]
        lists = [(lengths[i], [i]) for i in own] + [(0, []) for _ in range(k - len(own))]
        lists.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (lists[-1][0] - lists[0][0], next(ticket), lists))
    return [sorted(p) for p in _merged(heap, ticket)] if heap else [[] for _ in range(k)]


def _merged(heap: list[tuple], ticket: count) -> list[list]:
    """The nodes (difference of sums, ticket, lists of a sum and members) as one, those that differ most first."""
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        lists = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda x: -x[0])
        heapq.heappush(heap, (lists[-1][0] - lists[0][0], next(ticket), lists))
    return [p for _, p in heap[0][2]]


def merge_shards(sums: list[list[int]]) -> list[list[tuple[int, int]]]:
    """Which lists (shard, list) make up each of the k lists, from the sums of every shard's k lists."""
    ticket, heap = count(), []
    for shard, own in enumerate(sums):
        lists = sorted(((n, [(shard, p)]) for p, n in enumerate(own)), key=lambda x: -x[0])
        heapq.heappush(heap, (lists[-1][0] - lists[0][0], next(ticket), lists))
    return _merged(heap, ticket)


def greedy(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Rows in their order, each to the lightest list; with a bias that fills all lists alike on demand."""
    bias = sum(lengths) + 1 if equal_size else 0
    lists, sums = [[] for _ in range(k)], [0] * k
    for i, n in enumerate(lengths):
        to = sums.index(min(sums))
        lists[to].append(i)
        sums[to] += n + bias
    return lists


def balanced(rows: DataFrame, batch: str, key: str, length: str, k: int, equal_size: bool = True, method=largest_differencing, shard: int | None = None) -> DataFrame:
    """(batch, key, length, partition): lists of each batch, batches side by side.

    Batches of any size: beyond ``shard`` rows they are dealt in two levels,
    by shards of neighbours by key, with sums no further apart than the
    longest row. Lists of equal size need a number of rows that k goes into.
    """
    shard = max(k, (shard or SHARD) // k * k)
    kept = rows.select(batch, key, F.col(length).cast("long").alias(length))
    counts = kept.groupBy(batch).count().agg(F.max("count").alias("most"), F.max(F.when(F.col("count") % k != 0, F.col("count"))).alias("odd")).first()
    if equal_size and counts.odd:
        raise ValueError(f"{counts.odd} rows can't be dealt into {k} lists of equal size")
    types = dict(kept.dtypes)
    if (counts.most or 0) <= shard:
        return kept.groupBy(batch).applyInPandas(_deal(key, length, k, equal_size, method, [batch, key, length, "partition"]), f"`{batch}` {types[batch]}, `{key}` {types[key]}, `{length}` long, partition int")
    placed = ranked_within(kept, batch, [key], "__place").withColumn("__shard", F.floor((F.col("__place") - 1) / shard).cast("int")).drop("__place")
    schema = f"`{batch}` {types[batch]}, `{key}` {types[key]}, `{length}` long, __shard int, partition int"
    dealt = placed.groupBy(batch, "__shard").applyInPandas(_deal(key, length, k, equal_size, method, [batch, key, length, "__shard", "partition"]), schema)
    dealt = written_down(dealt.withColumnRenamed("partition", "__list"), shared_folder(rows.sparkSession, "balanced"))
    sums = dealt.groupBy(F.col(batch).alias("__b"), F.col("__shard").alias("__s"), F.col("__list").alias("__l")).agg(F.sum(length).alias("sum"))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        table = [[0] * k for _ in range(int(group["__s"].max()) + 1)]
        for s, p, n in zip(group["__s"], group["__l"], group["sum"], strict=True):
            table[s][p] = int(n)
        found = [(group["__b"].iloc[0], s, p, to) for to, members in enumerate(merge_shards(table)) for s, p in members]
        return pd.DataFrame(found, columns=["__b", "__s", "__l", "partition"])

    # a row for each list of each shard
    merged = sums.groupBy("__b").applyInPandas(merge, f"__b {types[batch]}, __s int, __l int, partition int")
    return dealt.join(merged, F.col(batch).eqNullSafe(F.col("__b")) & (F.col("__shard") == F.col("__s")) & (F.col("__list") == F.col("__l"))).select(batch, key, length, "partition")


def _deal(key: str, length: str, k: int, equal_size: bool, method, columns: list[str]):
    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key, kind="stable").reset_index(drop=True)
        for p, members in enumerate(method([int(x) for x in group[length]], k, equal_size)):
            group.loc[members, "partition"] = p
        group["partition"] = group["partition"].astype("int32")
        return group[columns]

    return deal


def micro_batches(rows: DataFrame, batch: str, length: str, max_tokens: int) -> DataFrame:
    """(batch, micro_batches): how many each needs within the token budget, the same for all: the most that one needs."""
    need = rows.groupBy(batch).agg(F.ceil(F.sum(length) / max_tokens).cast("long").alias("own"))
    most = need.agg(F.max("own").alias("micro_batches"))
    return need.join(F.broadcast(most)).select(batch, "own", "micro_batches")
