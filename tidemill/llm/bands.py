"""What operator 9's ``drop_near_copies`` links beyond the fingerprints' radius: candidates from bands of minima, confirmed by exact Jaccard similarity of five-word shingles.

Texts of the same words share one key. A pair at the limit of 0.8 misses all
bands, of ``ROWS`` minima each, in 3 of 100,000 cases, a pair at 0.85 in 4 of
ten million. What shares a band meets in one task, with a sketch of each text;
only pairs that may reach the limit and that would connect something leave it,
so that their number follows that of the texts and not the size of a bucket.
They are confirmed by their whole sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm._shared import Scratch, arrow_schema, batch_of, join_counted, release, slices, utf8
from tidemill.llm.components import components

SHINGLE, SEED, BANDS, ROWS = 5, 42, 20, 4
#: The least similarity, and how many of its standard errors an estimate may lie below it.
LIMIT, ERRORS = 0.8, 4
#: Bins of a sketch, one byte each: as a power of two.
BINS = 9
#: Members of a bucket in one block; larger buckets are compared by pairs of blocks.
BLOCK = 2_000
#: Rounds that count likely pairs as links for the time being, and pairs of a text that the next one tries; each round then tries four times as many as the one before.
HOPEFUL, TRIES = 2, 16
#: Rows to look at, of two numbers each, up to which these are broadcast.
MAX_SENT = 500_000
_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, np.uint64)[:, None]


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct hashes of all runs of five words."""
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_digest, b" ".join
    return np.unique(np.frombuffer(b"".join([digest(join(s), SEED) for s in zip(*(words[k:] for k in range(SHINGLE)), strict=False)] or [digest(join(words), SEED)]), ">u8").astype(np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """For each band the hash of its minima, as a signed 64-bit integer."""
    least = np.full(len(_MIX), (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 4096):  # long texts by stretches
        x = (hashes[at : at + 4096] ^ _MIX) * np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=1))
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big", signed=True)


def sketch(hashes: np.ndarray) -> bytes:
    """A byte for each bin of the hashes, by their highest bits: 0 for an empty one, else by the bin's least hash. ``hashes`` are sorted."""
    out = np.zeros(1 << BINS, np.uint8)
    bins = (hashes >> np.uint64(64 - BINS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = (hashes[first] % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def sketches(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, the key of the words, the number of distinct shingles, the bands, the SimHash fingerprint of the shingles, and their sketch."""
    long = T.LongType()
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("key", long, False), T.StructField("w", long, False), T.StructField("bands", T.ArrayType(long, False), False), T.StructField("fp", long, False), T.StructField("sketch", T.BinaryType(), False)])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        target = arrow_schema(schema)
        for batch in slices(batches, 200):
            found = []
            for t in batch.column(n):
                words = words_of(t.as_py())
                s = shingles(words)
                found.append((xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63), len(s), bands(s), majority(s), sketch(s)))
            yield batch_of(target, [*(batch.column(i) for i in range(n)), *(list(x) for x in zip(*found, strict=True))])

    return docs.select(*keep, utf8(text).alias("__text")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(key, shingles) of the wanted rows (__row, key), a row for each key; only these texts travel, or none if the wanted are few."""
    sent = F.broadcast(wanted) if wanted.count() <= MAX_SENT else wanted
    there = docs.select("__row", utf8(text).alias("__text")).join(sent, "__row").select("key", "__text")
    schema = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("shingles", T.ArrayType(T.LongType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        target = arrow_schema(schema)
        for batch in slices(batches, 200):
            yield batch_of(target, [batch.column(0), pa.array([shingles(words_of(t.as_py())).view(np.int64) for t in batch.column(1)], target.field("shingles").type)])

    # equal rows share their number
    return there.mapInArrow(run, schema).dropDuplicates(["key"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingles have at least four fifths of their union in common; ``sets`` has those of all keys in them."""
    asked = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).groupBy("key").agg(F.count("*").alias("n"))
    known = sets.join(asked, "key")
    total = 2 * pairs.count()
    left = join_counted(pairs, known.select(F.col("key").alias("a"), F.col("shingles").alias("x"), "n"), "a", total)
    both = join_counted(left, known.select(F.col("key").alias("b"), F.col("shingles").alias("y"), "n"), "b", total)
    # common / (x + y - common) >= 4 / 5
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def by_key(roots: DataFrame) -> DataFrame:
    """(key, root), the roots themselves included."""
    return roots.select(F.col("node").alias("key"), "root").unionByName(roots.select(F.col("root").alias("key"), "root")).distinct()


def promising(keys: np.ndarray, roots: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, sides: np.ndarray, failed: list[list[int]], tries: int, hopeful: bool) -> list[tuple[int, int]]:
    """Pairs of keys, the smaller first, of different roots, that may be similar enough: those that would connect something, the likeliest first.

    ``keys`` are sorted; ``failed`` are, for each, the larger keys that it was
    compared with in vain. Only pairs of different ``sides`` count, if there
    are two. Where that is ``hopeful``, pairs estimated at the limit or above
    count as links from then on, so that no pair within what they connect is
    tried; if one turns out not to be a link, the next round sees it among the
    failed. Of other pairs, estimated below the limit by no more than the
    error, each text gets ``tries`` in a round. No pair means that none is left.
    """
    full = sketches != 0
    filled = full.sum(axis=1)
    found, mixed = [], len(set(sides.tolist())) > 1
    for i in range(len(keys) - 1):
        fit = (roots[i + 1 :] != roots[i]) & (5 * np.minimum(sizes[i], sizes[i + 1 :]) >= 4 * np.maximum(sizes[i], sizes[i + 1 :]))
        if mixed:
            fit &= sides[i + 1 :] != sides[i]
        if failed[i]:
            fit &= ~np.isin(keys[i + 1 :], failed[i])
        others = np.flatnonzero(fit) + i + 1
        if not len(others):
            continue
        at = np.flatnonzero(full[i])  # elsewhere nothing can agree
        agree = (sketches[np.ix_(others, at)] == sketches[i, at]).sum(axis=1)
        seen = filled[i] + filled[others] - full[np.ix_(others, at)].sum(axis=1)
        all_ = (sizes[i] + sizes[others]) / (1 + LIMIT)  # of the union, at the limit
        error = np.sqrt(LIMIT * (1 - LIMIT) / seen * np.maximum(0.0, 1 - seen / all_))
        likely = agree / seen
        found += [(-likely[k], i, int(others[k])) for k in np.flatnonzero(likely >= LIMIT - ERRORS * error - 1e-9).tolist()]
    root: dict[int, int] = {}

    def top(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out, tried = [], np.zeros(len(keys), np.int64)
    for unlikely, i, j in sorted(found):
        x, y = top(int(roots[i])), top(int(roots[j]))
        if x == y:
            continue
        if hopeful and -unlikely >= LIMIT:
            root[y] = x
        elif min(tried[i], tried[j]) >= tries:
            continue
        else:
            tried[[i, j]] += 1
        out.append((int(keys[i]), int(keys[j])))
    return out


def candidates(left: DataFrame, tries: int, hopeful: bool) -> DataFrame:
    """(band, a, b): the promising pairs of every bucket; ``left`` has band, n (members of the bucket), key, root, w, sketch and failed."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    dealt = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("h"), "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "key", "root", "w", "sketch", "own", "failed")
    ordered = dealt.repartition(F.col("h")).sortWithinPartitions("h", "band", "p", "q", "key")
    schema = T.StructType([T.StructField(c, T.LongType(), False) for c in ("band", "a", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        target, members = arrow_schema(schema), []
        current = None

        def found() -> pa.RecordBatch:
            keys, roots, sizes, sketches, sides, failed = zip(*members, strict=True)
            pairs = promising(np.array(keys), np.array(roots), np.array(sizes), np.frombuffer(b"".join(sketches), np.uint8).reshape(len(keys), -1), np.array(sides), list(failed), tries, hopeful)
            members.clear()
            return batch_of(target, [[current[0]] * len(pairs), [a for a, _ in pairs], [b for _, b in pairs]])

        for batch in slices(batches):
            for band, p, q, *rest in zip(*(batch.column(k).to_pylist() for k in range(1, 10)), strict=True):
                if (band, p, q) != current:
                    if len(members) > 1:
                        yield found()
                    current = (band, p, q)
                    members.clear()
                members.append(rest)
        if len(members) > 1:
            yield found()

    return ordered.mapInArrow(run, schema)


def linked(keys: DataFrame, near: DataFrame, docs: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """(node, root): the components of the links between keys.

    ``keys`` has key, __row (one of ``docs`` with these words), w, bands and
    sketch; ``near`` (a, b) are tried first. Rounds end when no pair of any
    bucket is left that may be a link and isn't tried.
    """
    rows = keys.where("w > 0").select("key", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    # rows of two numbers, of which adaptive execution splits those of a frequent band
    members = scratch.write(rows.join(buckets.select("band"), "band"), "buckets")
    pairs, tried, links, roots, number = scratch.write(near, "pairs"), None, None, None, 0
    while True:
        wanted = keys.join(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), "key").select("__row", "key")
        sets = scratch.write(shingle_sets(docs, text, scratch.write(wanted, "wanted")), "shingles")
        good = scratch.write(confirmed(pairs, sets), "links")
        scratch.drop(sets)
        tried, links = (pairs, good) if tried is None else (tried.unionByName(pairs), links.unionByName(good))
        if roots is None or good.count():
            # what is connected goes on as stars, so that only what is new takes rounds
            roots = components(good if roots is None else roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(good), scratch.write)
        total = members.count()
        named = members.join(by_key(roots), "key", "left").withColumn("root", F.coalesce("root", "key"))
        parts = named.groupBy("band", "root").agg(F.count("*").alias("m"))
        open_ = parts.groupBy("band").agg(F.sum("m").alias("n"), F.count("*").alias("k")).where("k > 1").select("band", "n", F.col("n").alias("size"))
        left = scratch.write(join_counted(named, open_, "band", total).withColumnRenamed("size", "n"), "open")
        failed = tried.join(links, ["a", "b"], "left_anti").groupBy("a").agg(F.collect_list("b").alias("failed"))
        inside = left.select("key").distinct().join(keys.select("key", "w", "sketch"), "key").join(failed, F.col("key") == F.col("a"), "left").select("key", "w", "sketch", F.coalesce("failed", F.array().cast("array<long>")).alias("failed"))
        hopeful = number < HOPEFUL
        found = scratch.write(candidates(left.join(inside, "key"), TRIES * 4 ** max(0, number - HOPEFUL), hopeful), "found")
        pairs, number = scratch.write(found.select("a", "b").distinct(), "pairs"), number + 1
        if pairs.count() == 0:
            return roots
        # a bucket without a pair has none left
        active = found.groupBy("band").agg(F.count("*").alias("n"))
        before, members = members, scratch.write(left.select("band", "key").join(active.select("band"), "band", "left_semi"), "buckets")
        scratch.drop(before, left, found)
