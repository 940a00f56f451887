from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemill.operators import curation, records, selection


def md5(seed, *key) -> str:
    return hashlib.md5("|".join(map(str, [seed, *key])).encode()).hexdigest()


@pytest.mark.parametrize("digits", [1, 4, 32])
def test_first_by_hash_is_a_sort(spark, monkeypatch, digits):
    monkeypatch.setattr(selection, "FEW", 0)
    monkeypatch.setattr(selection, "DIGITS", digits)
    rows = spark.range(700).select("id", (F.col("id") % 3).alias("x")).repartition(5)
    for n in (1, 2, 350, 699, 700, 701):
        got = sorted(r.id for r in selection.first_by_hash(rows, n, 7, ["id", "x"]).collect())
        assert got == sorted(sorted(range(700), key=lambda k: md5(7, k, k % 3))[:n])
    assert selection.first_by_hash(rows, 0, 7, ["id"]).count() == selection.first_by_hash(rows.limit(0), 5, 7, ["id"]).count() == 0


def test_rows_of_one_hash_are_cut_exactly(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 0)
    rows = spark.range(300).select(F.lit("same").alias("k"), "id").unionByName(spark.range(50).select(F.concat(F.lit("k"), "id").alias("k"), "id"))
    for n in (1, 40, 200, 330):
        got = selection.first_by_hash(rows, n, 42, ["k"]).collect()
        before = sum(md5(42, f"k{i}") < md5(42, "same") for i in range(50))
        assert len(got) == n and sum(r.k != "same" for r in got) == min(n, before) + max(0, n - before - 300)


def test_fill_up_without_a_one_partition_limit(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 0)
    rows = spark.range(5000).select("id", (F.col("id") % 10 / 10).alias("score"))
    got = curation.fill_up(rows, curation.in_band(F.col("score")), 4000, ["id"])
    others = sorted((k for k in range(5000) if k % 10 not in (3, 4, 5, 6, 7, 8)), key=lambda k: md5(42, k))
    assert sorted(r.id for r in got.where("filled").collect()) == sorted(others[: 4000 - got.where("not filled").count()])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 4097])
def test_permutations_and_their_inverse(spark, n):
    rows = spark.range(n).select("id", selection.permuted(F.col("id"), n, 5).alias("p"), selection.permuted(F.col("id"), n, 6).alias("q"))
    got = rows.withColumn("back", selection.unpermuted(F.col("p"), n, 5)).collect()
    assert sorted(r.p for r in got) == sorted(r.q for r in got) == list(range(n)) and all(r.back == r.id for r in got)
    if n >= 97:
        assert [r.p for r in got] != [r.q for r in got]
        # neighbours don't stay neighbours
        assert sum(abs(got[k].p - got[k + 1].p) <= 2 for k in range(n - 1)) < n / 10


def test_numbers_beyond_32_bits(spark):
    n = 3_000_000_000_000_007
    rows = spark.range(n - 2000, n).select("id", selection.permuted(F.col("id"), n, 5).alias("p"))
    got = rows.withColumn("back", selection.unpermuted(F.col("p"), n, 5)).collect()
    assert all(0 <= r.p < n and r.back == r.id for r in got) and len({r.p for r in got}) == 2000
    assert max(r.p for r in got) - min(r.p for r in got) > n / 2


def test_mini_batches_go_on_from_any_batch(spark):
    rows = spark.range(100).select((F.col("id") * 7).alias("key")).repartition(3)
    whole = records.mini_batches(rows, "key", 8, epochs=3)
    every = sorted(map(tuple, whole.select("epoch", "batch", "idx", "key").collect()))
    for e in range(3):
        own = [r for r in every if r[0] == e]
        assert [r[2] for r in own] == list(range(100)) and sorted(r[3] for r in own) == [7 * k for k in range(100)] and all(r[1] == r[2] // 8 for r in own)
    assert len({tuple(r[3] for r in every if r[0] == e) for e in range(3)}) == 3
    rest = records.mini_batches(rows, "key", 8, epochs=3, start=(1, 5))
    assert sorted(map(tuple, rest.select("epoch", "batch", "idx", "key").collect())) == [r for r in every if (r[0], r[1]) >= (1, 5)]
    assert records.mini_batches(rows, "key", 8, epochs=1, start=(1, 0)).count() == records.mini_batches(rows.limit(0), "key", 8).count() == 0
