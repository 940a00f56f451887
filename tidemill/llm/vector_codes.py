"""Vectors as a few bytes: a codebook for each part of the vector, learned in rounds, whose nearest entries Orchard's search finds.

Components become integers, so that distances, sums and ties are exact and the
result does not depend on how rows are dealt out. Each task adds up its own
rows by entry; what is gathered for a round is one sum for each entry and
component, whatever the number of rows.

Defined results: rows whose vector is null or holds null or non-finite numbers
are dropped. The length of a codebook's vectors is that of most rows among
lengths that can be cut into equal parts (ties: the longer); a row of another
length, or with a component of 2**20 or more once it is an integer, stays with a
null code and error, and takes no part in the learning. Repeated rows count as
often as they come; rows without an id come after all others; fewer rows than
entries make smaller codebooks; an empty table has no codebook and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm._shared import arrow_schema, batch_of, join_counted, kept, materialize, release, slices

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Size of an integer component from which a distance might not be exact in 64 bits.
LARGE = 1 << 20
#: Vectors whose searches go in step.
AT_ONCE = 4_000


def integers(vector: str, scale: int) -> Column:
    """The components as integers, rounded down; null if the vector is not to be kept."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    # beyond the bound the number itself no longer matters
    whole = lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(2.0 * LARGE)), F.lit(-2.0 * LARGE)))
    return F.when(fine, F.transform(x, whole))


@dataclass(frozen=True)
class Codebooks:
    """``entries[p, e]`` is entry e for part p, as integers."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Orchard:
    """Nearest entries of one codebook by distance-sorted neighbour lists.

    A search goes along the list of the best entry so far and jumps to the list
    of any better one. No entry further from it than twice its own distance can
    be better or as good, so there the search stops. Many vectors go in step.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(float)  # whole numbers of a size that stays exact
        apart = np.stack([((entries - e) ** 2).sum(axis=1) for e in entries])
        self.lists = np.argsort(apart, axis=1, kind="stable")
        # a row beyond what 4 * distance can reach ends every list
        self.apart = np.append(np.take_along_axis(apart, self.lists, axis=1).astype(float), np.full((len(entries), 1), np.inf), axis=1)
        sums = entries.sum(axis=1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each row and its squared distance; of equals the lowest entry."""
        n, k = len(rows), len(self.entries)
        first = np.searchsorted(self.sums, rows.sum(axis=1))
        start = self.by_sum[np.minimum(first, k - 1)]  # any entry will do; one of a like mean is often near
        rows = rows.astype(float)
        found, nearest = start.copy(), np.zeros(n, np.int64)
        # what goes on: the row, its best entry and distance, its place in that entry's list, and what it has seen
        going, best, at = np.arange(n), start, np.zeros(n, np.int64)
        apart = rows - self.entries[best]
        least = np.einsum("ij,ij->i", apart, apart)
        seen = np.zeros((n, k), bool)
        seen[going, best] = True
        while len(going):
            over = self.apart[best, at] > 4 * least
            if over.any():
                done = going[over]
                found[done], nearest[done] = best[over], least[over]
                on = ~over
                going, best, least, at = going[on], best[on], least[on], at[on]
                continue
            other = self.lists[best, at]
            at += 1
            new = np.flatnonzero(~seen[going, other])
            if not len(new):
                continue
            asked, other = going[new], other[new]
            seen[asked, other] = True
            apart = rows[asked]
            apart -= self.entries[other]
            d = np.einsum("ij,ij->i", apart, apart)
            old = least[new]
            better = (d < old) | ((d == old) & (other < best[new]))
            moved = new[better]
            best[moved], least[moved], at[moved] = other[better], d[better], 0
        return found, nearest


def _searches(books: Codebooks) -> list[Orchard]:
    return kept(("orchard", books.digest()), lambda: [Orchard(e) for e in books.entries])


def _nearest(books: Codebooks, column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows as (row, part, component), and the entry and distance of each part."""
    parts, _, width = books.entries.shape
    rows = column.flatten().to_numpy().reshape(-1, parts, width)
    found = [search.nearest(rows[:, p]) for p, search in enumerate(_searches(books))]
    return rows, np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def prepare(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the kept rows, and the length of the vectors to learn from: v is null where it can't be coded."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), integers(vector, scale).alias("v")).where("v is not null")
    rows = materialize(rows.withColumn("v", F.when(F.forall("v", lambda x: F.abs(x) < LARGE), F.col("v"))), "vectors")
    sizes = rows.groupBy(F.size("v").alias("size")).count().where((F.col("size") > 0) & (F.col("size") % parts == 0))
    size = sizes.agg(F.max(F.struct("count", "size")).alias("most")).select("most.size").first()[0] or 0
    return rows.withColumn("v", F.when((F.size("v") == size) & F.lit(size > 0), F.col("v"))), size


def start(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the rows with the smallest ids."""
    first = [r.v for r in rows.where("v is not null").select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    return Codebooks(np.array(first, np.int64).reshape(len(first), parts, size // parts).swapaxes(0, 1))


def learn(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the mean of the parts that are nearest to it, rounded down."""
    parts, entries, width = books.entries.shape
    schema = T._parse_datatype_string("part int, entry int, place int, total long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        totals, n = np.zeros(books.entries.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in slices(batches, AT_ONCE):
            values, codes, _ = _nearest(books, batch.column(0))
            for p in range(parts):
                np.add.at(totals[p], codes[:, p], values[:, p])
                n[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        each = lambda x: np.repeat(x, width)
        yield batch_of(arrow_schema(schema), [each(part), each(entry), np.tile(np.arange(width), len(part)), totals[part, entry].ravel(), each(n[part, entry])])

    sums = rows.where("v is not null").select("v").mapInArrow(run, schema).groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    following = books.entries.copy()
    for r in sums.collect():  # one for each component of each entry
        following[r.part, r.entry, r.place] = int(r.total) // r.n
    return Codebooks(following)


def train(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks for rows as ``prepare`` makes them."""
    books = start(rows, size, parts, entries)
    for _ in range(rounds if books.entries.size else 0):
        books = learn(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part (more, if a book has over 256 entries), and the squared distance."""
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    digits = max(2, len(f"{max(0, books.entries.shape[1] - 1):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, AT_ONCE):
            there = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            code, error = np.full(len(there), None, object), np.full(len(there), None, object)
            if there.any():
                _, codes, apart = _nearest(books, batch.column(2))
                code[there] = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
                error[there] = apart.sum(axis=1)
            yield batch_of(arrow_schema(schema), [batch.column(0), batch.column(1), code.tolist(), error.tolist()])

    return rows.select("vec_id", "label", "v").mapInArrow(run, schema)


def decode(codes: DataFrame, books: Codebooks, scale: int = SCALE, code: str = "code") -> DataFrame:
    """The codes' own columns and ``vector``: the entries that the code names, back at the vectors' scale; null for a null code."""
    parts, n, _ = books.entries.shape
    digits = max(2, len(f"{max(0, n - 1):x}"))
    schema = T.StructType([*codes.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))])
    at = codes.columns.index(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, AT_ONCE):
            back = [None if c is None else (np.concatenate([books.entries[p, int(c[p * digits : (p + 1) * digits], 16)] for p in range(parts)]) / scale).tolist() for c in batch.column(at).to_pylist()]
            yield batch_of(arrow_schema(schema), [*batch.columns, back])

    return codes.mapInArrow(run, schema)


def report(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (the errors of all rows of one label, those without a label together) and codebooks_sha256."""
    rows, size = prepare(vectors, vector, vec_id, label)
    books = train(rows, size)
    coded = materialize(encode(rows, books).withColumn("of", F.struct("label")), "codes")
    labels = coded.groupBy("of").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("n"))
    named = join_counted(coded, labels, "of", coded.count())
    return named.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
