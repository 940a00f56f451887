"""Wording similarity within batches, and the share of a batch that each text's cluster makes up.

Clusters of average linkage never reach beyond the connected parts of the pairs
within the cut: two clusters join at a mean distance of at most the cut, so some
pair of theirs is within it. So the pairs within the cut are found first, by
n-grams that such pairs must share, and only what is connected by them is
clustered, each part in a task of its own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.quota import ranked_within
from tidemill.storage import shared_folder, written_down

ORDER, SMALL = 4, 0.1
#: Different wordings in a block; pairs of blocks are compared in a task each.
BLOCK = 1_000


def bleu(reference: list[str], hypothesis: list[str], order: int = ORDER, small: float = SMALL) -> float:
    """Uniform weights up to four words; an order without a hit counts as a tenth of one."""
    if not hypothesis:
        return 0.0
    logs = 0.0
    for n in range(1, order + 1):
        own = Counter(tuple(hypothesis[k : k + n]) for k in range(len(hypothesis) - n + 1))
        other = Counter(tuple(reference[k : k + n]) for k in range(len(reference) - n + 1))
        hits, of = sum((own & other).values()), max(1, sum(own.values()))
        if n == 1 and not hits:
            return 0.0
        logs += math.log((hits or small) / of) / order
    brevity = 1.0 if len(hypothesis) > len(reference) else math.exp(1 - len(reference) / len(hypothesis))
    return brevity * math.exp(logs)


def _grams(words: list[str], n: int) -> list[tuple[str, ...]]:
    return list(zip(*(words[k:] for k in range(n)), strict=False))


def needed_order(length: int, least: float) -> int:
    """The longest n-gram that a hypothesis of this many words must share for a BLEU of ``least``; 0 if it can't reach that.

    No precision is over 1. Without a common n-gram, this and all longer
    orders count as a tenth of one hit.
    """
    bound = lambda n: math.prod(SMALL / max(1, length - k + 1) for k in range(n, ORDER + 1)) ** (1 / ORDER)
    if length == 0 or bound(length + 1) < least * (1 - 1e-9):
        return 0
    return next((n for n in range(min(ORDER, length), 1, -1) if bound(n) < least * (1 - 1e-9)), 1)


def close_pairs(left: list[list[str]], right: list[list[str]], least: float, same: bool = False) -> list[tuple[int, int]]:
    """Pairs (of left, of right) with a BLEU of at least ``least`` in one direction: enough of them to connect all that have it.

    A hypothesis meets only those that share an n-gram of the order it needs.
    How many it shares bounds its precision of that order from above, and with
    the brevity its BLEU: beyond that bound no pair is scored, nor one that is
    connected already. ``same``: both sides are one list.
    """
    n = len(left)
    root = list(range(n if same else n + len(right)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    links = []
    for refs, hyps, turned in ((right, left, False), (left, right, True))[: 1 if same else 2]:
        needs = [needed_order(len(h), least) for h in hyps]
        sizes = np.array([len(r) for r in refs])
        for order in sorted(set(needs) - {0}):
            where: dict[tuple, list[int]] = {}
            for k, words in enumerate(refs):
                for g in set(_grams(words, order)):
                    where.setdefault(g, []).append(k)
            held = {g: np.array(rows) for g, rows in where.items()}
            for h, words in enumerate(hyps):
                if needs[h] != order:
                    continue
                found = [(held[g], times) for g, times in Counter(_grams(words, order)).items() if g in held]
                if not found:
                    continue
                hits = np.zeros(len(refs), np.int64)
                for rows, times in found:
                    hits[rows] += times
                brevity = np.minimum(1.0, np.exp(1 - sizes / len(words)))
                bound = brevity * (hits / max(1, len(words) - order + 1)) ** (1 / ORDER)
                for r in np.flatnonzero(bound >= least * (1 - 1e-9)).tolist():
                    a, b = (r, h) if turned else (h, r)
                    x, y = top(a), top(b if same else n + b)
                    if x != y and bleu(refs[r], words) >= least:
                        root[y] = x
                        links.append((a, b))
    return links


def distances(texts: list[list[str]], before: np.ndarray) -> np.ndarray:
    """1 - BLEU of all pairs, the mean over the copies of both: ``before[i, j]`` of them have i ahead of j, which makes i the hypothesis."""
    m, lengths = len(texts), np.array([len(t) for t in texts])
    logs, none = np.zeros((m, m)), np.zeros((m, m), bool)
    for n in range(1, ORDER + 1):
        rows: dict[tuple, list[int]] = {}
        for k, words in enumerate(texts):
            for g, times in Counter(_grams(words, n)).items():
                for t in range(times):  # min(x, y) is how many levels both reach
                    rows.setdefault((g, t), []).append(k)
        hits = np.zeros((m, m), np.int32)
        for members in rows.values():
            if len(members) > 1:
                hits[np.ix_(members, members)] += 1
        if n == 1:
            none = hits == 0
        logs += np.log(np.where(hits > 0, hits, SMALL) / np.maximum(1, lengths - n + 1)[:, None]) / ORDER
    size = np.maximum(1, lengths)
    brevity = np.where(lengths[:, None] > lengths[None], 1.0, np.exp(1 - lengths[None] / size[:, None]))
    own = np.where(none, 0.0, brevity * np.exp(logs))  # own[i, j]: i is the hypothesis, j the reference
    apart = ((1 - own) * before + (1 - own.T) * before.T) / np.maximum(1, before + before.T)
    np.fill_diagonal(apart, 0.0)
    return apart


def average_linkage(distance: np.ndarray, cut: float, weights: np.ndarray | None = None) -> list[int]:
    """Cluster numbers: the two nearest clusters join while their mean distance is at most ``cut``; of equals the first.

    Each row keeps its nearest neighbour, so that a step looks at one number
    for each row and works out only the rows anew whose neighbour has gone.
    """
    n = len(distance)
    d, size = distance.astype(float).copy(), np.ones(n) if weights is None else weights.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    near = d.argmin(axis=1) if n else np.zeros(0, np.int64)
    least, into = d[np.arange(n), near], np.arange(n)
    while n > 1:
        i = int(least.argmin())
        j = int(near[i])
        if not least[i] <= cut:
            break
        i, j = min(i, j), max(i, j)
        mean = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = mean, mean
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        into[into == j] = i
        again = np.flatnonzero((near == i) | (near == j))
        nearer = (d[:, i] < least) | ((d[:, i] == least) & (i < near))
        near[nearer], least[nearer] = i, d[nearer, i]
        for k in {i, j, *again.tolist()}:
            near[k] = d[k].argmin()
            least[k] = d[k, near[k]]
    return into.tolist()


def _wordings(rows: DataFrame, batch: str, key: str, text: str) -> DataFrame:
    """(batch, key, wording, place): words as they are split, and the place of each row in its batch."""
    types = dict(rows.dtypes)

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(wording=[" ".join((t or "").split()) for t in part.pop("wording")])

    kept = rows.select(F.col(batch).alias("batch"), F.col(key).alias("key"), F.col(text).alias("wording"))
    return ranked_within(kept.mapInPandas(split, f"batch {types[batch]}, key {types[key]}, wording string"), "batch", ["key", "wording"], "place")


def _connected(links: DataFrame, kind: str) -> DataFrame:
    """(batch, first, root) for all wordings that have links: one task for a batch, which holds two numbers for each of its linked wordings."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, root = object(), {}

        def top(k: int) -> int:
            while root.setdefault(k, k) != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        def found() -> pd.DataFrame:
            names = sorted(root)
            return pd.DataFrame({"batch": [current] * len(names), "first": names, "root": [top(k) for k in names]})

        for part in parts:
            for b, x, y in zip(part["batch"], part["a"], part["b"], strict=True):
                b = None if pd.isna(b) else b
                if b != current:
                    if root:
                        yield found()
                    current, root = b, {}
                x, y = top(x), top(y)
                root[max(x, y)] = min(x, y)
        if root:
            yield found()

    return links.repartition("batch").sortWithinPartitions("batch").mapInPandas(run, f"batch {kind}, first long, root long")


def cluster_share(rows: DataFrame, batch: str, key: str, text: str, cut: float = 0.5, block: int = BLOCK) -> DataFrame:
    """(batch, key, share): which part of its batch each text's cluster is. Batches of any size.

    Copies of a wording are one weighted text: they are nearer to each other
    than to anything else, so that they join first, or never if they are short
    and the cut is low. Blocks of wordings are compared pair by pair of blocks;
    the task of a connected part of m wordings holds some 60 bytes for each
    pair of them, and a number for each of their rows.
    """
    if not 0 <= cut < 1:
        raise ValueError("the cut lies from 0 to below 1")
    spark, kind = rows.sparkSession, dict(rows.dtypes)[batch]
    folder = shared_folder(spark, "wordings")
    least = 1 - cut
    placed = written_down(_wordings(rows, batch, key, text), f"{folder}/rows")
    wordings = written_down(placed.groupBy("batch", "wording").agg(F.min("place").alias("first"), F.count("*").alias("n")), f"{folder}/wordings")
    totals = wordings.groupBy(F.col("batch").alias("__b")).agg(F.sum("n").alias("rows"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    numbered = wordings.join(totals, F.col("batch").eqNullSafe(F.col("__b"))).drop("__b")
    own = F.pmod(F.xxhash64("wording"), F.col("blocks")).cast("int")
    dealt = numbered.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("batch", "wording", "first", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first")
        p, q = int(group["p"].iloc[0]), int(group["q"].iloc[0])
        sides = [group[group["own"] == s] for s in ((p,) if p == q else (p, q))]
        words = [[w.split(" ") if w else [] for w in s["wording"]] for s in sides]
        ids = [s["first"].tolist() for s in sides]
        found = [(group["batch"].iloc[0], ids[0][a], ids[-1][b]) for a, b in close_pairs(words[0], words[-1], least, same=p == q)]
        return pd.DataFrame(found, columns=["batch", "a", "b"])

    links = dealt.groupBy("batch", "p", "q").applyInPandas(compare, f"batch {kind}, a long, b long")
    parts = written_down(_connected(links, kind), f"{folder}/parts")
    linked = placed.alias("r").join(wordings.alias("w"), F.col("r.batch").eqNullSafe(F.col("w.batch")) & (F.col("r.wording") == F.col("w.wording")))
    linked = linked.join(parts.alias("c"), F.col("r.batch").eqNullSafe(F.col("c.batch")) & (F.col("w.first") == F.col("c.first")))
    linked = linked.select("r.batch", "c.root", "w.first", "r.wording", "r.place")

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        each = [(first, g["wording"].iloc[0], np.sort(g["place"].to_numpy())) for first, g in group.groupby("first", sort=True)]
        places, weights = [e[2] for e in each], np.array([len(e[2]) for e in each])
        before = np.zeros((len(each), len(each)))
        for i, mine in enumerate(places):
            for j in range(i + 1, len(each)):
                before[j, i] = np.searchsorted(places[j], mine).sum()
                before[i, j] = len(mine) * len(places[j]) - before[j, i]
        labels = np.array(average_linkage(distances([w.split(" ") for _, w, _ in each], before), cut, weights))
        return pd.DataFrame({"batch": [group["batch"].iloc[0]] * len(each), "first": [e[0] for e in each], "size": [int(weights[labels == x].sum()) for x in labels]})

    clusters = linked.groupBy("batch", "root").applyInPandas(cluster, f"batch {kind}, first long, size long")
    # a wording's copies are apart if even they are beyond the cut
    apart = [k for k in range(ORDER) if 1 - bleu(list("abc")[:k], list("abc")[:k]) > cut]  # in words; from four on copies are equal
    alone = F.when(F.col("n.wording") == "", 0).otherwise(F.size(F.split("n.wording", " "))).isin(*apart)
    sized = numbered.alias("n").join(clusters.alias("c"), F.col("n.batch").eqNullSafe(F.col("c.batch")) & (F.col("n.first") == F.col("c.first")), "left")
    count = F.coalesce("c.size", F.when(F.col("n.n") == 1, 1).when(alone, 1).otherwise(F.col("n.n")))
    shares = sized.select(F.col("n.batch").alias("__b"), F.col("n.wording").alias("__w"), (count / F.col("n.rows")).alias("share"))
    return placed.join(shares, F.col("batch").eqNullSafe(F.col("__b")) & (F.col("wording") == F.col("__w"))).select(F.col("batch").alias(batch), F.col("key").alias(key), "share")
