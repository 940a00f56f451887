"""SimHash near-duplicates: fingerprints, linked through BK-trees, and their components.

Fingerprints within ``RADIUS`` bits of each other agree on at least one of
four 16-bit parts, so each part's value names a shard, and every link lies in
some shard. A shard's BK-tree is searched along the edges within the radius
while it is built; only a spanning forest of its links leaves the task. A
shard that holds many fingerprints is cut by its remaining bits in the same
way until it is small, which loses no link.

Defined results: a null or empty text, or one of white space, has fingerprint
zero, which is linked like any other; repeated rows come out repeated; rows
without an id take part and show the component of their text.

``drop_near_copies`` keeps one document of each group of near copies by
another measure than three bits: see there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import bands
from tidemill.llm._shared import Scratch, arrow_schema, batch_of, join_counted, materialize, release, slices, utf8
from tidemill.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints in a shard beyond which it is cut further; a count, so that none is left out.
DENSE = 2_000
#: Crowded shards, of 50 bytes or so, up to which their table is broadcast.
MAX_SENT = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_digest
    join = b" ".join
    votes = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    for at in range(0, n, 1 << 16):  # long texts by stretches
        part = words[at : at + (1 << 16) + shingle - 1]
        hashes = np.frombuffer(b"".join([digest(join(s), SEED) for s in zip(*(part[k:] for k in range(shingle)), strict=False)]), np.uint8)
        votes += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` and the fingerprint, as a signed 64-bit integer."""
    keep = ["doc_id"] if keep is None else keep
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("fp", T.LongType(), False)])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        target = arrow_schema(schema)
        for batch in slices(batches):
            prints = np.array([fingerprint(t or b"") for t in batch.column(n).to_pylist()], np.uint64)
            yield batch_of(target, [*(batch.column(i) for i in range(n)), pa.array(prints.view(np.int64))])

    return docs.select(*keep, utf8(text).alias("__text")).mapInArrow(run, schema)


class BKTree:
    """Fingerprints, each below the child that has its distance to the parent.

    Keys within a radius of another lie below edges within the radius of its
    distance to their parent.
    """

    def __init__(self):
        self.keys: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, key: int) -> int:
        self.keys.append(key)
        self.children.append({})
        new = len(self.keys) - 1
        k = 0
        while k != new:
            k = self.children[k].setdefault((self.keys[k] ^ key).bit_count(), new)
        return new


def shard_links(keys: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between different keys of one shard.

    Branches known to lie in the key's own component are not searched, which
    keeps a dense cluster from being compared pair by pair.
    """
    tree = BKTree()
    for key in keys:
        tree.add(key)
    root, links = list(range(len(keys))), []
    one = [-1] * len(keys)  # a node of the component that the whole branch lies in

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def settle() -> None:
        for k in range(len(keys) - 1, -1, -1):  # children come after their parent
            own = top(k)
            one[k] = own if all(one[c] != -1 and top(one[c]) == own for c in tree.children[k].values()) else -1

    pause = 16
    for k, key in enumerate(keys):
        if k == pause:
            settle()
            pause *= 2
        todo, mine = [0], top(k)
        while todo:
            x = todo.pop()
            if one[x] != -1 and top(one[x]) == mine:
                continue
            d = (keys[x] ^ key).bit_count()
            if d <= radius and top(x) != mine:
                links.append((keys[x], key))
                root[top(x)] = mine
            todo += [c for e, c in tree.children[x].items() if -radius <= e - d <= radius]
    return links


def pieces(free: int, n: int = 4) -> list[int]:
    """``n`` masks that share out the set bits of ``free``, from the lowest on."""
    bits = [1 << b for b in range(64) if free >> b & 1]
    return [sum(bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


FULL = (1 << 64) - 1
PARTS = pieces(FULL)


def _signed(column) -> np.ndarray:
    return np.array(column, np.uint64).view(np.int64)


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shards(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """(fp, mask): each fingerprint in the shards of all that share its bits under the mask, so that every link lies in some shard.

    A shard of more than ``dense`` is cut by its free bits, again and again:
    three differences spare one of four pieces of them. With eight free bits
    left there are no more than 256 fingerprints.
    """
    spark = prints.sparkSession
    rows = prints.select("fp", F.explode(F.array(*(F.lit(_long(m)) for m in PARTS))).alias("mask"))
    done = None
    while True:
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        crowded = materialize(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > dense).drop("n"), "crowded")
        n = crowded.count()
        free = [(m, FULL & ~m) for (m,) in crowded.select("mask").distinct().collect()]  # four times as many from cut to cut, 16,384 at last
        cut = [(m, [_long(m & FULL | piece) for piece in pieces(f)]) for m, f in free if f.bit_count() > 8]
        if not cut:
            return rows if done is None else done.unionByName(rows)
        finer = crowded.join(F.broadcast(spark.createDataFrame(cut, "mask long, finer array<long>")), "mask")
        marked = rows.join(F.broadcast(finer) if n <= MAX_SENT else finer, ["mask", "value"], "left")
        rest = marked.where("finer is null").drop("finer")
        done = rest if done is None else done.unionByName(rest)
        rows = materialize(marked.where("finer is not null").select("fp", F.explode("finer").alias("mask")), "shards")


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within the radius: enough of them to connect all that are linked.

    ``prints`` has distinct values in ``fp``.
    """
    if radius != RADIUS:
        raise ValueError("the four parts hold for a radius of 3")
    sc_schema = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.LongType(), False)])
    grouped = shards(prints, dense).select("fp", F.xxhash64("mask", "value").alias("h"), "mask", "value")
    ordered = grouped.repartition(F.col("h")).sortWithinPartitions("h", "mask", "value", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(sc_schema)
        current, members, links = None, [], []

        def close():
            if len(members) > 1:
                links.extend(shard_links(members, radius))

        def found() -> pa.RecordBatch:
            out = batch_of(target, [pa.array(_signed([x for x, _ in links])), pa.array(_signed([y for _, y in links]))])
            links.clear()
            return out

        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            keys = np.stack([batch.column(i).to_numpy() for i in (2, 3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(fps)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                name = tuple(keys[:, lo].tolist())
                if name != current:
                    close()
                    current, members = name, []
                members += fps[lo:hi].tolist()
            if links:
                yield found()
        close()
        if links:
            yield found()

    return ordered.mapInArrow(run, sc_schema)


def _named(prints: DataFrame, total: int) -> DataFrame:
    """fp, n (rows that have it) and component_id of every fingerprint."""
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "prints")
    roots = components(fingerprint_links(firsts.select("fp")))
    grouped = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    linked = grouped.join(firsts.select("fp", "first"), "fp")
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = join_counted(linked.select("fp", "root"), lowest, "root", total).select("fp", "component_id")
    return firsts.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id that links reach."""
    prints = materialize(with_fingerprint(docs, text, [doc_id]), "prints").withColumnRenamed(doc_id, "doc_id")
    total = prints.count()
    names = materialize(_named(prints, total), "names")
    return join_counted(prints, names, "fp", total).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__row", F.xxhash64(*(x for c in docs.columns for x in (F.col(c), F.col(c).isNull()))))


def _first(doc_id: str, key: str) -> Column:
    """The row that stays: with the smallest id, then by the key and the whole row; null ids come last."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), key, "__row")).alias("first")


def _first_rows(firsts: DataFrame, roots: DataFrame) -> DataFrame:
    """The numbers of the rows that are first in their component, from (key, first) and (key, root)."""
    named = firsts.join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root"))
    return named.agg(F.min("first").alias("first")).select("first.__row").distinct()


def _rows_of(whole: DataFrame, numbers: DataFrame) -> DataFrame:
    return whole.join(numbers, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component of the fingerprints, in the documents' own columns; equal rows are one."""
    whole = _numbered(docs)
    prints = with_fingerprint(whole, text, [doc_id, "__row"])
    firsts = materialize(prints.withColumnRenamed("fp", "key").groupBy("key").agg(_first(doc_id, "key")), "prints")
    return _rows_of(whole, _first_rows(firsts, bands.by_key(components(fingerprint_links(firsts.select(F.col("key").alias("fp")))))))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of near copies, in the documents' own columns.

    Near copies have at least four fifths of their five-word shingles in
    common, which chains. Links within three bits of the five-word
    fingerprints come first; as these leave most pairs at that similarity
    apart, ``bands`` brings the other candidates. All are confirmed by their
    whole shingles.

    Texts without a word are copies of each other; a text of up to five words
    is one shingle; equal rows are one.
    """
    whole, scratch = _numbered(docs), Scratch(docs.sparkSession, "near")
    sketched = bands.sketches(whole, text, [doc_id, "__row"])
    each = sketched.groupBy("key").agg(_first(doc_id, "key"), *(F.first(c).alias(c) for c in ("w", "bands", "fp", "sketch")))
    keys = scratch.write(each.withColumn("__row", F.col("first.__row")), "keys")
    roots = bands.linked(keys, near_keys(keys), whole, text, scratch)
    firsts = materialize(_first_rows(keys.select("key", "first"), bands.by_key(roots)), "firsts")
    scratch.clear()
    return _rows_of(whole, firsts)


def near_keys(keys: DataFrame) -> DataFrame:
    """Pairs (a, b) of different keys whose fingerprints link: enough to connect all that do."""
    prints = keys.where("w > 0").select("fp", "key")
    heads = materialize(prints.groupBy("fp").agg(F.min("key").alias("head"), F.count("*").alias("n")), "heads")
    same = join_counted(prints, heads.where("n > 1"), "fp", prints.count()).select(F.col("head").alias("a"), F.col("key").alias("b"))
    links = fingerprint_links(heads.select("fp"))
    of = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_key"))
    across = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b"))
    return same.unionByName(across).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
