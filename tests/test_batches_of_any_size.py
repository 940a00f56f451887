from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import balance, similarity


def plain_linkage(distance, cut):
    n = len(distance)
    d, size, label = distance.copy(), np.ones(n), list(range(n))
    np.fill_diagonal(d, np.inf)
    while n > 1:
        i, j = sorted(map(int, np.unravel_index(np.argmin(d), d.shape)))
        if not d[i, j] <= cut:
            break
        mean = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = mean, mean
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        label = [i if x == j else x for x in label]
    return label


def plain_shares(texts, cut):
    words = [t.split() for t in texts]
    distance = np.zeros((len(texts), len(texts)))
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            distance[i, j] = distance[j, i] = 1 - similarity.bleu(words[j], words[i])
    labels = plain_linkage(distance, cut)
    return [labels.count(x) / len(labels) for x in labels]


def some_texts(chance, n):
    base = [[f"w{chance.randrange(60)}" for _ in range(chance.choice([1, 2, 3, 4, 5, 9, 20]))] for _ in range(max(1, n // 5))]
    texts = []
    for _ in range(n):
        words = list(chance.choice(base))
        for _ in range(chance.choice([0, 0, 1, 2, 4])):
            words[chance.randrange(len(words))] = f"w{chance.randrange(60)}"
        if chance.random() < 0.2:
            words.insert(chance.randrange(len(words)), words[0])
        texts.append(" ".join(words))
    return [*texts, "", "  ", "w1\n w2  w3"]


@pytest.mark.parametrize("least", [0.2, 0.5, 0.7])
def test_no_close_pair_is_passed_over(least):
    for seed in range(20):
        words = [t.split() for t in some_texts(random.Random(seed), 40)]
        for left, right, same in ((words, words, True), (words[:20], words[20:], False)):
            shift = 0 if same else len(left)
            root = list(range(shift + len(right)))
            for a, b in similarity.close_pairs(left, right, least, same):
                old, new = root[shift + b], root[a]
                root = [new if x == old else x for x in root]
            for a, x in enumerate(left):
                for b, y in enumerate(right):
                    if max(similarity.bleu(x, y), similarity.bleu(y, x)) >= least and (not same or a != b):
                        assert root[a] == root[shift + b]


def test_linkage_is_the_plain_one():
    chance = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        for digits in (1, 2, 9):  # with ties and without
            x = chance.random((n, n)).round(digits)
            x = (x + x.T) / 2
            assert similarity.average_linkage(x, 0.45) == plain_linkage(x, 0.45)


@pytest.mark.parametrize("cut", [0.3, 0.5, 0.75])
def test_shares_are_the_plain_ones(spark, cut):
    rows, expected = [], {}
    for batch, seed in ((1, 1), (2, 2), (None, 3)):
        texts = some_texts(random.Random(seed), 60)
        rows += [(batch, k, t) for k, t in enumerate(texts)]
        expected |= {(batch, k): s for k, s in enumerate(plain_shares(texts, cut))}
    df = spark.createDataFrame([*rows, (3, 0, None), (4, 0, "a b c d"), (4, 1, "a b c d")], "batch long, key long, text string").repartition(5)
    got = {(r.batch, r.key): r.share for r in similarity.cluster_share(df, "batch", "key", "text", cut, block=17).collect()}
    assert got == pytest.approx(expected | {(3, 0): 1.0, (4, 0): 1.0, (4, 1): 1.0})
    assert similarity.cluster_share(df.limit(0), "batch", "key", "text").count() == 0


def test_shares_of_a_large_batch(spark):
    # families of ten wordings, each four times, and texts of their own
    family = F.floor(F.col("id") % 4000 / 10)
    text = F.when(F.col("id") < 16_000, F.concat_ws(" ", *(F.concat(F.lit(f"f{k}x"), family) for k in range(8)), F.concat(F.lit("v"), F.col("id") % 4000))).otherwise(F.concat_ws(" ", *(F.concat(F.lit(f"u{k}x"), "id") for k in range(6))))
    rows = spark.range(20_000).select(F.lit(0).alias("batch"), "id", text.alias("text"))
    got = similarity.cluster_share(rows, "batch", "id", "text").groupBy("share").count().collect()
    assert {round(r.share * 20_000): r["count"] for r in got} == {40: 16_000, 1: 4_000}


@pytest.mark.parametrize("equal", [True, False])
def test_two_levels_stay_within_the_longest_row(spark, equal):
    chance = random.Random(3)
    rows = [(b, k, chance.choice([1, 5, 40, chance.randrange(1, 3000)])) for b, n in ((0, 640), (1, 96), (None, 32)) for k in range(n)]
    df = spark.createDataFrame(rows, "batch long, id long, n long").repartition(4)
    for k in (4, 8):
        got = balance.balanced(df, "batch", "id", "n", k, equal, shard=100).collect()
        assert sorted((r.batch, r.id, r.n) for r in got if r.batch is not None) == sorted(r for r in rows if r[0] is not None) and len(got) == len(rows)
        for b in (0, 1, None):
            own = [r for r in got if r.batch == b]
            sums = [sum(r.n for r in own if r.partition == p) for p in range(k)]
            assert max(sums) - min(sums) <= max(r.n for r in own)
            if equal:
                assert {sum(r.partition == p for r in own) for p in range(k)} == {len(own) // k}
        one = balance.balanced(df.where("batch = 1"), "batch", "id", "n", k, equal).collect()
        again = balance.largest_differencing([r.n for r in sorted(one, key=lambda r: r.id)], k, equal)
        assert sorted(sorted(r.id for r in one if r.partition == p) for p in range(k)) == sorted(again)
    with pytest.raises(ValueError, match="equal size"):
        balance.balanced(df, "batch", "id", "n", 7, True, shard=100)


def test_shards_with_wide_sums_are_merged_within_the_widest():
    chance = random.Random(5)
    for _ in range(50):
        k = chance.randrange(1, 9)
        sums = [[chance.randrange(1000) for _ in range(k)] for _ in range(chance.randrange(1, 12))]
        merged = balance.merge_shards(sums)
        totals = [sum(sums[s][p] for s, p in own) for own in merged]
        assert sorted(x for own in merged for x in own) == [(s, p) for s in range(len(sums)) for p in range(k)]
        assert max(totals) - min(totals) <= max(max(s) - min(s) for s in sums) and math.isclose(sum(totals), sum(map(sum, sums)))
