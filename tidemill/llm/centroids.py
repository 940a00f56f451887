"""Rounds of centroid clustering, with the nearest centroid found by the equal-average equal-variance search.

Centroids are sorted by the sum of their components. A vector looks at them
from the place of its own sum outwards. The difference of sums, and with it the
difference of deviations from the mean, bounds the distance from below: what
they rule out is not looked at, and the rest is settled in whole numbers.

Components become integers, so that distances, sums and ties are exact and the
result does not depend on how rows are dealt out. Each task adds up its own
rows by centroid; what is gathered for a round is one sum for each centroid and
component, whatever the number of rows.

Defined results: rows whose vector is null, has not the wanted number of
components, or holds null or non-finite numbers, or integers of 2**30 / size or
more, are dropped. Repeated rows count as often as they come, and may all be
centroids at the start (ties by the vector); rows without an id are clustered,
but don't become one of the first centroids; fewer rows with an id than
centroids make fewer of these; without any, no row comes out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm._shared import arrow_schema, batch_of, kept, materialize, release, slices

SIZE, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Size of the sum of a vector's integer components from which a bound might not be exact in 64 bits.
LARGE = 1 << 30


class EqualAverage:
    """The nearest of the centroids, which are rows of integers."""

    def __init__(self, centroids: np.ndarray):
        self.order = np.argsort(centroids.sum(axis=1), kind="stable")
        self.centroids = centroids[self.order]
        self.sums, self.spread = self.moments(self.centroids)

    @staticmethod
    def moments(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums, and the roots of size * sum of squares - sum ** 2, which is size * deviation."""
        sums = rows.sum(axis=1)
        return sums, np.sqrt((rows.shape[1] * (rows**2).sum(axis=1) - sums**2).astype(float))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The centroid of each row (of equals the lowest), its squared distance, and how many distances that took in all."""
        n, k, size = len(rows), len(self.centroids), rows.shape[1]
        sums, spread = self.moments(rows)
        best, least, asked = np.full(n, k), np.full(n, np.iinfo(np.int64).max // size), 0
        up = np.searchsorted(self.sums, sums)
        down = up - 1

        def look(going: np.ndarray, at: np.ndarray) -> None:
            nonlocal asked
            # (difference of sums)**2 + (difference of spreads)**2 <= size * distance; a little less, for the roots are rounded
            bound = (sums[going] - self.sums[at]).astype(float) ** 2 + (spread[going] - self.spread[at]) ** 2
            maybe = bound * (1 - 1e-9) - 1 <= size * least[going].astype(float)
            going, at = going[maybe], at[maybe]
            asked += len(going)
            d, name = ((rows[going] - self.centroids[at]) ** 2).sum(axis=1), self.order[at]
            better = (d < least[going]) | ((d == least[going]) & (name < best[going]))
            best[going[better]], least[going[better]] = name[better], d[better]

        for place, step in [(up, 1), (down, -1)] * k:
            inside = np.flatnonzero((place >= 0) & (place < k))
            # beyond the first sum that is too far, all are
            near = (sums[inside] - self.sums[place[inside]]).astype(float) ** 2 * (1 - 1e-9) <= size * least[inside].astype(float)
            place[inside[~near]] = -1 if step < 0 else k
            look(inside[near], place[inside[near]])
            place[inside[near]] += step
        return best, least, asked


def prepare(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the kept rows, v as integers."""
    x = F.col(vector)
    fine = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double") * scale) < LARGE // size), F.lit(False))
    rows = vectors.where((F.size(x) == size) & F.forall(x, fine))
    return materialize(rows.select(F.col(vec_id).alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("v")), "vectors")


def start(rows: DataFrame, centroids: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors of the ids whose hash is smallest."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(place.alias("place"), "v").where("place is not null").orderBy("place", "v").limit(centroids).collect()
    return np.array([r.v for r in first], np.int64)


def learn(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each centroid becomes the mean of its vectors, rounded down."""
    schema = T._parse_datatype_string("cluster int, place int, total long, n long")
    name = hashlib.sha256(centroids.tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        totals, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in slices(batches):
            values = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            found, _, _ = kept(("centroids", name), lambda: EqualAverage(centroids)).nearest(values)
            np.add.at(totals, found, values)
            n += np.bincount(found, minlength=len(n))
        there = np.flatnonzero(n)
        width = centroids.shape[1]
        yield batch_of(arrow_schema(schema), [np.repeat(there, width), np.tile(np.arange(width), len(there)), totals[there].ravel(), np.repeat(n[there], width)])

    sums = rows.select("v").mapInArrow(run, schema).groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    following = centroids.copy()
    for r in sums.collect():  # one for each component of each centroid
        following[r.cluster, r.place] = int(r.total) // r.n
    return following


def train(rows: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids of rows as ``prepare`` makes them."""
    found = start(rows, centroids, seed)
    for _ in range(rounds if len(found) else 0):
        found = learn(rows, found)
    return found


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of each row and the squared distance."""
    schema = T.StructType([rows.schema["vec_id"], T.StructField("cluster", T.IntegerType(), False), T.StructField("distance", T.LongType(), False)])
    name = hashlib.sha256(centroids.tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            values = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            found, apart, _ = kept(("centroids", name), lambda: EqualAverage(centroids)).nearest(values)
            yield batch_of(arrow_schema(schema), [batch.column(0), found, apart])

    return (rows if len(centroids) else rows.limit(0)).select("vec_id", "v").mapInArrow(run, schema)


def report(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    rows = prepare(vectors, vector, vec_id)
    centroids = train(rows)
    found = materialize(assign(rows, centroids), "clusters")
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    each = [(k, total, sum(sums.values()), digests[k]) for k, total in sorted(sums.items())]
    named = found.sparkSession.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
